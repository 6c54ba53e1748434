"""Column expressions and small numpy blocks."""
