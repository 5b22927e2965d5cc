"""Logical plans: filter documents compiled to columns, and the query builder."""
