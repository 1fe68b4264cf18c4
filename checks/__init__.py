"""Queries of the operators over the given tables, each with its SQL counterpart."""
