"""Plans of the keyword-search engine."""
