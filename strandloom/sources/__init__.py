"""Readers and writers of the text formats, with explicit schemas."""
