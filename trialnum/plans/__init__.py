"""End-to-end plans: extract, train, annotate."""
