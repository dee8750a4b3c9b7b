"""Values, predicates and aggregates as Spark expressions."""
