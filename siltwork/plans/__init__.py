"""Sessions, views and named queries with their DuckDB twins."""
