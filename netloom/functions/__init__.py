"""Column builders: addresses, predicates and scalar rules."""
