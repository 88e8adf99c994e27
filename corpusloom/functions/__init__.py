"""Column expressions: text, predicates, three-valued logic, versions."""
