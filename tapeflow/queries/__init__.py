"""Registered queries: each Spark callable next to its DuckDB twin."""
