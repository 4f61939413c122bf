"""Structured Streaming forms of the set operators."""
