"""Registered queries: each operator family applied to the tables, with the same in SQL."""
