"""Readers with declared schemas, and sinks. Rows are never inferred or silently dropped."""
