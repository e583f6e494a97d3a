"""DataFrame operators: profiling, filters, joins, cohort rates, reshape."""
