"""Structured Streaming wrappers."""

from pagelens.streaming.stream import drift_stream, extract_batch, read_page_stream, start

__all__ = ["drift_stream", "extract_batch", "read_page_stream", "start"]
