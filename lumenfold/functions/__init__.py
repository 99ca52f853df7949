"""Expressions that operators are built from."""
