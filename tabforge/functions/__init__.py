"""Column helpers, distributed ordered statistics, metrics and insight rules."""
