"""Streaming: the reference has no streams. Fitted transforms are pure
projections, so they apply unchanged to streaming DataFrames; see apply."""
