"""Incremental forms of verification and ingest."""
