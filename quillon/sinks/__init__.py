"""Sinks of the keyword-search engine."""
