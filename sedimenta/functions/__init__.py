"""Column expressions: names, text and identifiers."""
