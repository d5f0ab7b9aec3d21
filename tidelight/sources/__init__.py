"""Readers, file discovery, sinks and the views over the given tables."""
