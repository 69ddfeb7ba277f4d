"""DuckDB oracle SQL for the registered queries (independent of the Spark code)."""
