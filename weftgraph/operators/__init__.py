"""Operators of the code graph: extraction, name resolution, relationships, queries, traversals."""
