"""Incremental runs: resume by key, file-source streams with checkpoints."""
