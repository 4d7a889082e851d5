"""Registered queries: each operator on the test tables, with the same result in SQL."""
