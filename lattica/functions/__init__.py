"""Column functions: text, years and vectors."""
