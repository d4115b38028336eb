"""Structured Streaming forms of the merge and deduplication operators."""
