"""Queries that bind the operators to the given tables, each with its plain-SQL counterpart."""
