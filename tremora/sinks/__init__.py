"""Text formats and stream writers."""
