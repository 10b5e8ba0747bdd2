"""Column functions: boundary predicates, scalar helpers, canonical JSON."""
