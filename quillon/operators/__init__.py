"""Operators of the keyword-search engine."""
