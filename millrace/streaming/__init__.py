"""Structured Streaming over registered files and versioned tables."""

from millrace.streaming.windows import append_stream, windowed_counts

__all__ = ["append_stream", "windowed_counts"]
