"""functions of the record store."""
