"""Functions of the keyword-search engine."""
