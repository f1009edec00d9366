"""Span analytics over text, as DataFrame operators."""
