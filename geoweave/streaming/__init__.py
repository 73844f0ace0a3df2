"""Structured Streaming forms of the naturally incremental operators."""
