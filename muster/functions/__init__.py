"""Column functions, patterns and lookup tables."""
