"""Streaming forms of the exposure operators."""
