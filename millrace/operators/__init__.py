"""operators of the record store."""
