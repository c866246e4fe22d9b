"""Column expressions: text cleaning, term weights, cluster paths, vectors."""
