"""Value kernels, predicates, expressions and aggregates as Column builders; nothing here runs Python on executors."""
