"""The registered queries, and the same in DuckDB's SQL."""
