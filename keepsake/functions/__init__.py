"""Column functions: predicates, ordering, dates, text and vectors."""
