"""Sources and sinks: table catalog, CSV ingestion, versioned storage, export."""
