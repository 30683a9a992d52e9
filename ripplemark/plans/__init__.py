"""Composed jobs, test mapping and queries."""
