"""Structured Streaming forms of incremental operators."""
