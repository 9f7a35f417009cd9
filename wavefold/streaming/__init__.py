"""Structured Streaming forms of the trackers."""
