"""Column-expression builders (Catalyst expressions, no Python per row)."""
