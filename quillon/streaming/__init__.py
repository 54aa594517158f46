"""Streaming of the keyword-search engine."""
