"""Point-in-time reads of dated tables. All are plain filters, so dates prune partitions."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_as_of(df: DataFrame, snapshot_date: datetime.date) -> DataFrame:
    """The full copy taken on one date."""
    return df.filter(F.col("snapshot_date") == F.lit(snapshot_date))


def scd2_as_of(df: DataFrame, moment: datetime.date) -> DataFrame:
    """Versions valid at a moment; validity is half-open."""
    at = F.lit(moment)
    return df.filter((F.col("history_effective_from_ts") <= at) & (F.col("history_effective_to_ts") > at))


def scd2_as_of_after_go_live(df: DataFrame, moment: datetime.date, go_live: datetime.date) -> DataFrame:
    """As :func:`scd2_as_of` after the go-live date.

    Up to that date versions have no reliable end, so every version started by the
    moment is kept and a key may come back several times.
    """
    if moment > go_live:
        return scd2_as_of(df, moment)
    return df.filter(F.col("history_effective_from_ts") <= F.lit(moment))


def effective_between(df: DataFrame, date: datetime.date) -> DataFrame:
    """Rows whose closed validity interval holds the date."""
    return df.filter(F.lit(date).between(F.col("effective_from_date"), F.col("effective_to_date")))
