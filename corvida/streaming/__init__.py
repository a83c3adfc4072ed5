"""Structured Streaming entry points for scoring and journal upserts."""
