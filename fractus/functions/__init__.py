"""Column expressions: axis orders, rounding, cost fields and label predicates."""
