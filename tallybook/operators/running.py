"""Running sums that keep a hot key off a single task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.amounts import TOTAL
from tallybook.session import scratch_folder

ORDER = ("uid", "bank_transaction_date", "pr_on_behalf_of_id")


def in_ranges(daily: DataFrame, ranges: int | None = None) -> DataFrame:
    """``daily`` with ``part``, its range of (uid, date, owner): ascending, of about equal rows, however ids are spread.

    There are as many ranges as shuffle partitions unless ``ranges`` says otherwise. They come from a sample that
    another read could draw otherwise, so rows and their ``part`` are stored once.
    """
    spark = daily.sparkSession
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = daily.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id())
    path = f"{scratch_folder(spark)}/ranged"
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def running_balance(daily: DataFrame, ranges: int | None = None) -> DataFrame:
    """Running balance per ``uid`` over (date, owner).

    ``daily`` has one row per uid, date and owner. It is a prefix sum in two levels: rows are summed up within their
    range, and the totals of a uid's ranges give what each range starts from. A uid of very many rows, on one day or
    on many, fills several ranges, and so several tasks.
    """
    # One key for a uid, NULL included, by which rows, totals and their join are all partitioned.
    key = F.concat(F.when(F.col("uid").isNull(), "-").otherwise("+"), F.coalesce("uid", F.lit("")))
    ranged = in_ranges(daily, ranges).withColumn("_key", key)
    totals = ranged.groupBy("_key", "part").agg(F.sum("balance").alias("_total"))
    earlier = Window.partitionBy("_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_key", "part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_key", "part").orderBy(*ORDER[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_within", F.sum("balance").over(within))
    return (
        summed.join(before, ["_key", "part"], "inner")
        .withColumn("running_balance", (F.col("_before") + F.col("_within")).cast(TOTAL))
        .drop("_key", "part", "_before", "_within")
    )
