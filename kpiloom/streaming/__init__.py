"""Structured Streaming sinks for the event tables."""
