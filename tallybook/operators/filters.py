"""Row filters."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.constants import NON_OPERATING_PATTERNS
from tallybook.functions.labels import like_none


def operating_account_filter(
    df: DataFrame, account: str = "bank_account", patterns: Sequence[str] = NON_OPERATING_PATTERNS
) -> DataFrame:
    """Drop accounts whose name matches a pattern; a missing name is dropped too."""
    return df.filter(like_none(F.col(account), patterns))


def id_list_filter(df: DataFrame, key: str, ids: DataFrame | Sequence) -> DataFrame:
    """Keep rows whose key is listed: one semi join for values and one-column DataFrames alike.

    Ids are cast to the key's type; NULL ids match nothing. Spark broadcasts the list only if its size allows.
    """
    if not isinstance(ids, DataFrame):
        # An Arrow table has a known size, so that Spark can choose the join by it.
        texts = pa.array([None if i is None else str(i) for i in ids], pa.string())
        ids = df.sparkSession.createDataFrame(pa.table({"_listed": texts}))
    listed = ids.toDF("_listed").select(F.col("_listed").cast(df.schema[key].dataType))
    listed = listed.filter(F.col("_listed").isNotNull()).distinct()
    return df.join(listed, F.col(key) == F.col("_listed"), "left_semi")


def not_in_subquery(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """SQL ``key NOT IN (SELECT ...)`` over a one-column DataFrame, as a shuffle-able anti join.

    One NULL among the listed values leaves no row; a NULL key survives only an empty list.
    """
    listed = listed.toDF("_listed")
    facts = listed.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_listed").isNull(), 1)).alias("n_null")
    )
    # Both facts come from one single-row aggregate, read as scalar subqueries.
    no_null_listed = facts.select("n_null").scalar() == 0
    nothing_listed = facts.select("n").scalar() == 0
    known = listed.filter(F.col("_listed").isNotNull()).distinct()
    return df.join(known, F.col(key) == F.col("_listed"), "left_anti").filter(
        no_null_listed & (F.col(key).isNotNull() | nothing_listed)
    )


def any_nonzero(columns: Sequence[Column]) -> Column:
    """At least one measure differs from zero; unknown if all are NULL."""
    return reduce(or_, [column != 0 for column in columns])


def any_nonzero_filter(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(any_nonzero([F.col(c) for c in columns]))
