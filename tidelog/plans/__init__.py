"""Registered queries and their SQL for DuckDB."""
