"""Structured Streaming forms of the books and of text operators."""
