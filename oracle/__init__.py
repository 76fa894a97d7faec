"""DuckDB statements that compute the registered queries another way."""
