"""Registered queries: each module has QUERIES and the equivalent ORACLES for DuckDB."""
