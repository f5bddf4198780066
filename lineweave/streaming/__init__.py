"""Structured Streaming forms of the run log: retries, progress and completion."""
