"""Structured Streaming forms of the frame loop."""
