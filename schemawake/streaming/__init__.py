"""Incremental ingest by watermarks, as batch functions and streaming jobs."""
