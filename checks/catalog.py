"""All cases: key, Spark callable, DuckDB statement."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import cases_columns, cases_operators, cases_reports
from checks.fixtures import Tables, with_fixtures
from tallybook.session import apply_runtime_conf

ALL = {**cases_columns.CASES, **cases_operators.CASES, **cases_reports.CASES}


def _query(run) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(Tables(apply_runtime_conf(spark), str(sf_dir).rstrip("/")))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _query(run) for key, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {key: with_fixtures(sql) for key, (_, sql) in ALL.items()}
