"""Queries over the test tables, each with its DuckDB text where SQL can say it."""
