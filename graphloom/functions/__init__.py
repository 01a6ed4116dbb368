"""Column functions: identifiers, predicates, vectors."""
