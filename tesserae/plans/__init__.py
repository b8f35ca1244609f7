"""The catalogue of named queries over the standard tables."""
