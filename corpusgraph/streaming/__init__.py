"""Structured Streaming forms of the job queue, its progress and its audit log."""
