"""User-level operators: each takes a table of query points and one or more layers."""
