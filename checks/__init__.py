"""Queries over the given tables, one per operator, each with its SQL counterpart."""
