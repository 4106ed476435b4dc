"""plans of the record store."""
