"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal if they are identical once every character of ``[\\x20\\x09-\\x0D]`` is deleted.

1. Every row becomes an index entry (64-bit hash, SHA-256, doc_id), written once to the shared folder.
2. The directory has one slot for each value of the top ``DEPTH`` hash bits. A bucket with more than ``capacity``
   entries is overfull: the directory doubles and the bucket splits on the next bit, until it fits, holds one
   single hash, or no bit is left. All doublings are found in one pass over the slot counts.
   What still is too large (copies of one text) chains further pages, so that no task gets more than about
   ``capacity`` rows.
3. Each page has an owner task. It gets the texts of its hash range and compares their bytes: texts of one hash
   that differ become different links of the chain, and a link counts its rows and knows the one that stays. Pages
   of one bucket are then merged, again by bytes.
4. Entries meet their link by (hash, SHA-256), and take group size and the row that stays from it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import SPACES, Scratch, tagged, text_or_empty, unused_name

# Bits of the largest directory: 65,536 slots, which also bounds its broadcast (about 2 MB).
DEPTH = 16
CAPACITY = 50_000


def normalised(column: str = "text"):
    return F.regexp_replace(text_or_empty(column), f"[{SPACES}]+", "")


def hashed(norm: str) -> Column:
    """The hash whose top bits the directory is over. Any will do: texts that share it are told apart by their bytes."""
    return F.xxhash64(norm)


def _entries(docs: DataFrame) -> DataFrame:
    norm = docs.select("_tag", normalised().alias("norm"), "doc_id")
    return norm.select("_tag", "doc_id", hashed("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"))


def _slot(h: str):
    return F.shiftrightunsigned(h, 64 - DEPTH)


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """slot -> (bucket, pages); a bucket is named by its first slot and its local depth."""
    slots = entries.groupBy(_slot("h").alias("slot")).agg(
        F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    depths = F.sequence(F.lit(0), F.lit(DEPTH))
    paths = slots.select("*", F.explode(depths).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(slot, {DEPTH} - depth)")
    )
    buckets = paths.groupBy("depth", "prefix").agg(
        F.sum("n").alias("held"), (F.min("low") == F.max("high")).alias("one_hash")
    )
    fits = (F.col("held") <= capacity) | F.col("one_hash") | (F.col("depth") == DEPTH)
    chosen = (
        paths.select("slot", "depth", "prefix")
        .join(buckets.filter(fits), ["depth", "prefix"])
        .groupBy("slot")
        .agg(F.min(F.struct("depth", "prefix", "held")).alias("b"))
    )
    return chosen.select(
        "slot",
        F.expr(f"shiftleft(b.prefix, {DEPTH} - b.depth) * {DEPTH + 1} + b.depth").alias("bucket"),
        F.greatest(F.lit(1), F.ceil(F.col("b.held") / capacity)).cast("long").alias("pages"),
    )


def _links(docs: DataFrame, slots: DataFrame, scratch: Scratch) -> DataFrame:
    """The links of all chains, one for each text that differs in bytes: h, text_sha256, group_size and the row that stays."""
    points = F.char_length(text_or_empty())
    # Of equal texts: most code points, then smallest doc_id (null last), then first in the files.
    order = F.struct((-points).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_tag")
    texts = docs.select("_tag", normalised().alias("norm"), order.alias("row")).withColumn("h", hashed("norm"))
    pages = (
        texts.withColumn("slot", _slot("h"))
        .join(F.broadcast(slots), "slot")
        .select("bucket", F.pmod(F.xxhash64("_tag"), "pages").alias("page"), "pages", "h", "norm", "row")
        .repartition("bucket", "page")
        .groupBy("bucket", "page", "pages", "h", "norm")
        .agg(F.count("*").alias("n"), F.min("row").alias("row"))
    )
    found = scratch.keep(
        pages.select(
            "h",
            F.sha2("norm", 256).alias("text_sha256"),
            F.when(F.col("pages") > 1, F.col("norm")).alias("norm"),
            (F.col("pages") > 1).alias("chained"),
            "n",
            "row",
        ),
        "links",
    )
    columns = ["h", "text_sha256", "n", "row"]
    merged = found.filter("chained").groupBy("h", "norm", "text_sha256").agg(F.sum("n").alias("n"), F.min("row").alias("row"))
    every = found.filter("NOT chained").select(*columns).union(merged.select(*columns))
    two = F.concat(F.lit("Two texts share hash and SHA-256 "), "text_sha256")
    return (
        every.groupBy("h", "text_sha256")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("group_size"), F.min("row").alias("row"))
        .withColumn("_ok", F.when(F.col("texts") > 1, F.raise_error(two)).otherwise(F.lit(0)))
        .filter("_ok = 0")
        .select("h", "text_sha256", "group_size", F.col("row.doc_id").alias("keep_id"), F.col("row._tag").alias("keep_tag"))
    )


def _decided(docs: DataFrame, capacity: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    entries = scratch.keep(_entries(docs), "entries")
    slots = scratch.keep(directory(entries, capacity), "directory")
    return entries.join(_links(docs, slots, scratch), ["h", "text_sha256"]).select(
        "_tag", "doc_id", "keep_id", "group_size", (F.col("_tag") == F.col("keep_tag")).alias("kept"), "text_sha256"
    )


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text, any other columns).

    Null text counts as empty. Of equal texts the row with the most code points stays, then the smallest doc_id;
    a null doc_id comes after all others. Of rows that repeat a doc_id as well, the first of the scan is kept.
    An empty table gives no rows.
    """
    return _decided(tagged(docs.select("doc_id", "text")), capacity).drop("_tag")


def without_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs``, a scan of files, that stay; all its columns, whatever their names."""
    tag = unused_name(docs, "_tag")
    rows = tagged(docs, tag)
    decided = _decided(rows.select(F.col(tag).alias("_tag"), "doc_id", "text"), capacity)
    dropped = decided.filter("NOT kept").select(F.col("_tag").alias(tag))
    return rows.join(dropped, tag, "left_anti").drop(tag)
