"""Structured Streaming extensions (the batch pipeline does not need them)."""
