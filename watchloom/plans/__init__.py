"""Queries and jobs built from the operators."""
