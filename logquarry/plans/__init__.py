"""End-to-end plans put together from sources, operators and sinks."""
