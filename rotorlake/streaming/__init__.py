"""Structured Streaming forms of the ordered jobs."""
