"""Column expressions: tokens, redaction, scope predicates, vectors."""
