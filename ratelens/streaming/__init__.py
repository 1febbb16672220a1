"""Structured Streaming versions of the progress operators."""
