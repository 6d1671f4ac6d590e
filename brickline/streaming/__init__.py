"""Structured Streaming forms of the periodic refreshes."""
