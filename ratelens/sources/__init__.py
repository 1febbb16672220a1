"""Readers, parsers and sinks. Malformed input becomes reject rows, never a failed job."""
