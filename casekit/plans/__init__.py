"""Query plans: the feature table, named queries and their DuckDB oracles."""
