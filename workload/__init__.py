"""Queries over map layers derived from the driver tables, with SQL to check them."""
