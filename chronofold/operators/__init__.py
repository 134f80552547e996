"""Operators over logs and the tables around them."""
