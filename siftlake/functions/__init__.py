"""Column expressions: field access, predicates, text."""
