"""Column functions: text, vectors, scores, budgets."""
