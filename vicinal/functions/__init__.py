"""Column expressions: filters, projections, vectors, scalars."""
