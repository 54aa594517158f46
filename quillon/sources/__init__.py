"""Sources of the keyword-search engine."""
