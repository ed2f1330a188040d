"""Registered queries, each with its equal in DuckDB's SQL."""
