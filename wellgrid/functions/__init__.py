"""Column expressions: ids, hashed draws, vectors, text rules."""
