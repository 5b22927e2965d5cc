"""Tailing a log."""
