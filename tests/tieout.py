"""Comparison of two results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_sorted_rows(table):
    """Columns by name and rows as sorted text tuples of an Arrow table."""
    columns = sorted(table.column_names)
    return columns, sorted(
        tuple(str(value) for value in row) for row in zip(*[table.column(c).to_pylist() for c in columns])
    )


def tie_out(left: DataFrame, right: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Groups whose measure differs between two results, or that only one of them has."""
    a = left.select(*[F.col(k).alias(f"left_{k}") for k in keys], F.col(measure).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(*[F.col(k).alias(f"right_{k}") for k in keys], F.col(measure).alias("right_value"), F.lit(True).alias("in_right"))
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"left_{key}").eqNullSafe(F.col(f"right_{key}"))
    joined = a.join(b, condition, "full")
    return joined.filter(
        ~F.col("left_value").eqNullSafe(F.col("right_value")) | F.col("in_left").isNull() | F.col("in_right").isNull()
    ).select(*[F.coalesce(f"left_{k}", f"right_{k}").alias(k) for k in keys], "left_value", "right_value")
