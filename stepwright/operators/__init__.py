"""Relational operators on preference pairs."""
