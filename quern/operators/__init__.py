"""Aggregates and ranked searches."""
