"""Column functions: text analysis, URLs, citations, similarity."""
