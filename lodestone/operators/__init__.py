"""Relational operators of the audit; each takes DataFrames and returns one."""
