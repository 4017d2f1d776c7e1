"""Structured Streaming forms of incremental observation tables."""
