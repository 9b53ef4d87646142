"""Column functions: text, indicators, scoring, raw records, vectors."""
