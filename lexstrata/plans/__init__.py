"""Composed queries and their SQL twins, one module for each operator family."""
