"""Token files: Parquet with one list of ids for each document, in ascending order of documents.

Every file holds a range of doc_id. Its columns are ``doc_id``, ``part`` (number of the range), ``part_start`` (ids
before the document within the range), ``n_tokens`` and the list ``ids``; a document's place among all ids follows from
the sizes of the ranges, which are metadata. The few distinct ids of a list are dictionary-encoded, the rising metadata
columns are delta-encoded without dictionary, and row groups and pages are of a set size. Spark's writer leaves page
indexes, so a reader fetches metadata without ids, or the pages of a range of documents only.

Texts travel once, to their range; tokens are never shuffled. Spark's commit protocol keeps the files of finished tasks
only, so a lost executor costs its running tasks.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm.byte_bpe import loaded
from tallybook.llm.common import ship

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000
# Ids that a task hands over at a time.
CHUNK_IDS = 1_000_000

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
METADATA = ("doc_id", "part", "part_start", "n_tokens")


def _lists(ids: list[np.ndarray], counts: np.ndarray) -> pa.ListArray:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int32)))


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS
) -> None:
    """Encode the whole text of every row of ``docs`` (doc_id, text, any other columns) and write the files to a new folder.

    ``end_id`` is appended to each document. Null text counts as empty: the end id alone. Rows without doc_id come
    first; rows of one doc_id are ordered by a hash of the text and then the text, and may lie in several files; repeated rows are all written.
    An empty table gives a folder without rows. A very long text is one list, held whole by its task.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, written = loaded(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)

        def chunk(doc_ids, ids, start):
            counts = np.array([len(x) for x in ids], np.int64)
            starts = start + np.cumsum(counts) - counts
            columns = [
                pa.array(doc_ids, pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts),
                pa.array(counts), _lists(ids, counts),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[*METADATA, "ids"]), start + int(counts.sum())

        doc_ids, ids, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([encoder.encode(text.as_py()), end]))
                held += len(ids[-1])
                if held >= CHUNK_IDS:
                    made, written = chunk(doc_ids, ids, written)
                    yield made
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield chunk(doc_ids, ids, written)[0]

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The hash lets a doc_id of very many rows lie in several ranges.
    ordered = (
        rows.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie", "text")
        .select("doc_id", "text")
    )
    writer = ordered.mapInArrow(run, FILE_SCHEMA).write.option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", PAGE_BYTES)
    writer = writer.option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", "true")
    for name in METADATA:
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(folder)


def read_token_files(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows, of documents ``first`` to ``last`` if given: then only pages that can hold them are read.

    Columns that are not selected are not read, so metadata comes without ids.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    return rows if last is None else rows.filter(F.col("doc_id") <= last)


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` and ``base``, the ids of all ranges before it, from metadata. There are as many rows as files."""
    sizes = read_token_files(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("base"))


def with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` of the files with ``start``, the number of ids of all documents before. Spark broadcasts ``starts`` if it is small."""
    start = (F.col("base") + F.col("part_start")).alias("start")
    return rows.join(starts, "part").select("doc_id", start, *[c for c in rows.columns if c not in ("doc_id", "part", "part_start")])


def ids_crc32(ids: str = "ids") -> Column:
    """Unsigned CRC-32 of a list of ids as little-endian unsigned 32-bit numbers."""

    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lists:
            flat = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = column.offsets.to_numpy()
            yield pa.array([zlib.crc32(flat[a:b].data) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    return F.arrow_udf(run, "long")(ids)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files."""
    rows = read_token_files(spark, folder).select(*METADATA, ids_crc32().alias("ids_crc32"))
    return with_starts(rows, part_starts(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")
