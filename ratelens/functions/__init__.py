"""Column expressions: cleaning, flags, scores, formatting."""
