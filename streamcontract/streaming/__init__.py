"""Consumers on Structured Streaming."""
