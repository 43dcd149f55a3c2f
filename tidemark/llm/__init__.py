"""Training-data operators: ten corpus operators and their queries. Nothing outside this package imports it."""
