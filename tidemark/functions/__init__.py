"""Column expressions: text normalisation, parsers, scoring."""
