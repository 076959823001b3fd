"""Column functions on text, paths and identifiers."""
