"""Queries: operators applied to the tables of a folder."""
