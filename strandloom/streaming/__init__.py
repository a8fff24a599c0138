"""Structured Streaming forms of the read pipeline."""
