"""Column functions: text, vectors, scores and formats."""
