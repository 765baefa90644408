"""Whole-table reads and result sinks."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table_scan(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A whole table, by catalog name or as Parquet below a folder."""
    if folder is None:
        return spark.table(name)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(
    df: DataFrame,
    table: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
    path: str | None = None,
) -> None:
    """Save as a catalog table, its data below ``path`` if given.

    Dated copies are best partitioned by their snapshot date: each report reads one to
    three of them. Bucketing by a join key saves its shuffle, but a bucket is one task
    whatever its size, so it suits keys that are known to be spread evenly.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a report for accountants; every partition writes its own file. Values keep blanks and line breaks at their ends."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, escape='"', **keep).csv(path)


def write_jdbc(
    df: DataFrame, url: str, table: str, batch_size: int = 10_000, mode: str = "overwrite", **options: str
) -> None:
    """Load into a database, one connection per partition, committing batch-wise."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=batch_size, **options).save()
