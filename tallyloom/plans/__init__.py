"""Registered queries: each plan applies the operators to the given tables, with its SQL counterpart beside it."""
