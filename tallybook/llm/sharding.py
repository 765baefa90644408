"""Resharding to equal bytes by a minimum-cost flow of blocks.

Rows lie in old shards; rows of one text lie together. Each old shard is cut into blocks by hash ranges, so
that equal texts stay in one block; only a block that is too large by itself (copies of one text) is cut further.
From the old sizes and the new capacities a minimum-cost flow finds the transfers that move the fewest bytes.
Blocks then fill the transfers; every other block stays where it is, and only shards that
give or receive a block are written again.

The driver holds one number for each block: at most ``OLD_SHARDS * RANGES`` and some hundred more.
"""

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common import Scratch, tagged, text_or_empty

SHARDS = 24
OLD_SHARDS = 16
# Hash ranges for each old shard.
RANGES = 256
# A block larger than this part of a new shard is cut further.
PART_OF_SHARD = 100
# Rows for each task that numbers rows.
ROWS_EACH = 20_000
ROW_OVERHEAD = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (source, target) -> amount of least total cost that sends all supply; ``cost(i, j)`` for each unit.

    Successive shortest paths with potentials. Capacity must hold all supply.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than the old ones have")
    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    to, left, price, out = [], [], [], [[] for _ in range(n + m + 2)]

    def arc(a, b, room, each):
        for x, y, r, e in ((a, b, room, each), (b, a, 0, -each)):
            out[x].append(len(to))
            to.append(y)
            left.append(r)
            price.append(e)

    for i, s in enumerate(supply):
        arc(start, i, s, 0)
    for i, s in enumerate(supply):
        for j in range(m):
            arc(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        arc(n + j, end, c, 0)

    potential, owed = [0] * (n + m + 2), sum(supply)
    while owed:
        far, by = [float("inf")] * (n + m + 2), [-1] * (n + m + 2)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                near = d + price[e] + potential[x] - potential[to[e]]
                if left[e] and near < far[to[e]]:
                    far[to[e]], by[to[e]] = near, e
                    heapq.heappush(heap, (near, to[e]))
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        path, x = [], end
        while x != start:
            path.append(by[x])
            x = to[by[x] ^ 1]
        amount = min(owed, *(left[e] for e in path))
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount
        owed -= amount
    flow, first = {}, 2 * n
    for i in range(n):
        for j in range(m):
            if sent := left[first + 2 * (i * m + j) + 1]:
                flow[i, j] = sent
    return flow


def assign_blocks(blocks: list[tuple[object, int, int]], shards: int, old_shards: int) -> dict[object, int]:
    """New shard of each block (name, old shard, bytes)."""
    supply = [0] * old_shards
    for _, old, size in blocks:
        supply[old] += size
    total = sum(supply)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    owed = min_cost_flow(supply, capacity, lambda i, j: 0 if i == j else 1)
    placed, filled, of = {}, [0] * shards, {}
    # Large blocks first, each to the transfer of its old shard that lacks most.
    for name, old, size in sorted(blocks, key=lambda b: (-b[2], b[1], str(b[0]))):
        j = max(range(shards), key=lambda j: (owed.get((old, j), 0), -filled[j], j == old, -j))
        owed[old, j] = owed.get((old, j), 0) - size
        placed[name], of[name] = j, size
        filled[j] += size
    _even_out(placed, filled, of)
    return placed


def _even_out(placed: dict, filled: list[int], of: dict) -> None:
    """Move single blocks from the fullest to the emptiest shard while that narrows the gap."""
    held = {j: {n: of[n] for n in placed if placed[n] == j and of[n]} for j in range(len(filled))}
    for _ in range(10 * len(placed) + 100):
        high, low = max(range(len(filled)), key=filled.__getitem__), min(range(len(filled)), key=filled.__getitem__)
        gap = filled[high] - filled[low]
        fit = [(abs(gap / 2 - s), str(n), n) for n, s in held[high].items() if s < gap]
        if not fit:
            return
        name = min(fit)[2]
        size = held[high].pop(name)
        held[low][name], placed[name] = size, low
        filled[high] -= size
        filled[low] += size


def _measured(docs: DataFrame, old_shards: int) -> DataFrame:
    text = text_or_empty()
    old = F.col("_old") if "_old" in docs.columns else F.pmod(F.crc32(text.cast("binary")), F.lit(old_shards))
    return docs.select(
        "_tag",
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old.cast("int").alias("old_shard"),
        F.pmod(F.xxhash64(text), F.lit(RANGES)).cast("int").alias("range"),
    )


def plan_blocks(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): every row with its block, and (block, old_shard, shard, rows before it in the shard)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.keep(_measured(docs, old_shards), "rows")
    by_range = scratch.keep(
        rows.groupBy("old_shard", "range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "ranges"
    )
    total = by_range.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    most = max(1, total[0] // (shards * PART_OF_SHARD))
    # At most OLD_SHARDS * RANGES rows: a proven bound for the broadcast.
    cut = by_range.select("old_shard", "range", F.ceil(F.col("bytes") / most).alias("pieces"))
    piece = F.pmod(F.xxhash64("_tag", "doc_id"), F.col("pieces")).cast("int")
    rows = rows.join(F.broadcast(cut), ["old_shard", "range"]).select(
        "_tag", "doc_id", "size", "text_crc32", "old_shard",
        F.concat_ws("-", "old_shard", "range", piece).alias("block"),
    )
    sums = rows.groupBy("block", "old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    known = [tuple(r) for r in sums.collect()]
    placed = assign_blocks([(b, o, s) for b, o, s, _ in known], shards, old_shards)
    before, listed = [0] * shards, []
    for b, o, s, n in sorted(known, key=lambda x: x[0]):
        listed.append((b, o, placed[b], before[placed[b]]))
        before[placed[b]] += n
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("from_shard", T.IntegerType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("before", T.LongType()),
        ]
    )
    return rows, spark.createDataFrame(listed, schema)


def reshard(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard for every row of ``docs``.

    ``docs`` has doc_id and text, and may have ``_old``, the shard that a row lies in (else the CRC of its text
    decides). Null text has no bytes and the CRC of an empty one. Repeated rows are placed one by one. Slots count the rows of
    a shard from 0 without gaps: blocks in order of their name, in each block parts by hash, in each part by doc_id
    (null first). No task numbers more than a part. An empty table gives no rows.
    """
    rows, blocks = plan_blocks(tagged(docs), shards, old_shards)
    parts = max(1, -(-rows.count() // (ROWS_EACH * old_shards * RANGES)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("_tag"), F.lit(parts)))
    sizes = rows.groupBy("block", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(_window(["block"], ["part"]).rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.select("block", "part", F.coalesce(earlier, F.lit(0)).alias("in_block"))
    numbered = rows.withColumn("nth", F.row_number().over(_window(["block", "part"], ["doc_id", "_tag"])) - 1)
    # The block list is bounded, see the module's docstring.
    return (
        numbered.join(parts, ["block", "part"])
        .join(F.broadcast(blocks), "block")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("in_block") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "old_shard",
        )
    )


def rewrite_affected(spark, root: str, shards: int, old_shards: int, version: int) -> list[int]:
    """Reshard files below ``root`` (``shard=<n>/v=<version>``); returns the shards written.

    Only shards that give or receive a block get a folder of the next version; the others are not touched. Readers
    take each shard's highest version, so that a run that breaks off leaves the old state whole.
    """
    old = spark.read.parquet(root)
    latest = old.groupBy("shard").agg(F.max("v").alias("v"))
    docs = tagged(old).join(F.broadcast(latest), ["shard", "v"]).withColumnRenamed("shard", "_old").drop("v")
    docs = Scratch(spark).keep(docs, "rows")
    rows, blocks = plan_blocks(docs, shards, old_shards)
    moved = blocks.filter("from_shard <> shard")
    affected = sorted({r[0] for r in moved.selectExpr("explode(array(from_shard, shard))").distinct().collect()})
    if affected:
        to = rows.select("_tag", "block").join(F.broadcast(blocks.filter(F.col("shard").isin(affected))), "block")
        (
            docs.join(to.select("_tag", "shard"), "_tag")
            .drop("_tag", "_old")
            .withColumn("v", F.lit(version))
            .repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
            .write.mode("append")
            .partitionBy("shard", "v")
            .parquet(root)
        )
    return affected


def _window(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)
