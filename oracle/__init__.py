"""DuckDB statements that give the registered queries' rows."""
