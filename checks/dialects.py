"""The few spots where the SQL of the fixture tables differs between Spark and DuckDB."""

SPARK = {
    "ts": "TIMESTAMP_NTZ",
    "mdy2": lambda d: f"date_format({d}, 'MM/dd/yy')",
    "mdy4": lambda d: f"date_format({d}, 'MM/dd/yyyy')",
    "serial": lambda d: f"CAST(datediff({d}, DATE '1899-12-30') AS STRING)",
    "money": lambda x: f"format_number({x}, 2)",
    "days": "SELECT explode(sequence(DATE '2018-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS date",
    "month_name": lambda d: f"date_format({d}, 'MMMM')",
    "each": lambda *values: f"explode(array({', '.join(values)}))",
}
DUCKDB = {
    "ts": "TIMESTAMP",
    "mdy2": lambda d: f"strftime({d}, '%m/%d/%y')",
    "mdy4": lambda d: f"strftime({d}, '%m/%d/%Y')",
    "serial": lambda d: f"CAST({d} - DATE '1899-12-30' AS STRING)",
    "money": lambda x: f"format('{{:,.2f}}', CAST({x} AS DOUBLE))",
    "days": "SELECT CAST(unnest(range(DATE '2018-01-01', DATE '2026-01-01', INTERVAL 1 DAY)) AS DATE) AS date",
    "month_name": lambda d: f"strftime({d}, '%B')",
    "each": lambda *values: f"unnest([{', '.join(values)}])",
}
