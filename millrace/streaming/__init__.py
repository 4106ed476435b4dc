"""streaming of the record store."""
