"""Structured Streaming front end: query batches that arrive as files."""
