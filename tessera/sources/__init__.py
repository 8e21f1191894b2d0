"""Readers and the versioned table store."""
