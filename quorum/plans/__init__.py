"""Registered queries over the driver tables: each module has QUERIES and SQL with the same keys."""
