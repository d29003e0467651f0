"""Readers and writers: classification XML, versioned tables, product dumps, key/value metadata."""
