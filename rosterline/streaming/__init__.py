"""Structured Streaming forms of the storage and reporting operators."""
