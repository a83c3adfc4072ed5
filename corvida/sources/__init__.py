"""Readers, text-format parsers and writers."""
