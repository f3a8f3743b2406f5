"""DataFrame -> DataFrame operators: extraction, trees, dedup, compare, render."""
