"""The review jobs on Structured Streaming."""
