"""Queries built from the operators, with the SQL that says the same."""
