"""Structured Streaming: landed files, growing files, running totals."""
