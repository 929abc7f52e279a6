"""Readers and writers in the original formats, and stand-in inputs from the test tables."""
