"""Column functions: predicates, projections and display forms."""
