"""sources of the record store."""
