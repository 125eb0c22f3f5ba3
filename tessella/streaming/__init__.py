"""Structured Streaming (an extension)."""
