"""A typed object graph over Spark DataFrames: queries, facets, search, traversal and interval statistics."""
