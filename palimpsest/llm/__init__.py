"""Training-data operators: the ten corpus operators and the queries that apply them."""
