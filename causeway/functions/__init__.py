"""Column functions: text, vectors, numbers and time."""
