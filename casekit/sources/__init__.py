from casekit.sources.cases import (CASE_COLUMNS, case_table, cases_sql_duckdb, load_cases, read_table,
                                   write_table)

__all__ = ["CASE_COLUMNS", "case_table", "cases_sql_duckdb", "load_cases", "read_table", "write_table"]
