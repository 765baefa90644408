"""Approximate nearest neighbours by collision-counting hashing.

Each block of vectors is projected on ``LINES`` random directions; each projection is a sorted array of its own. A query
opens a window around its own projection in every array, as wide as a radius asks for, and counts for each vector the
windows it lies in. Windows grow with the radius (virtual rehashing: nothing is hashed again). Vectors with at
least ``threshold`` collisions are verified with their true cosine. A query stops once ``k`` verified vectors lie within its
radius; a vector within the radius misses the threshold with probability ``MISS`` at most. There is no cap on the vectors
verified, and at the largest radius all are, so k are found wherever there are as many.

Vectors are dealt into blocks by hash and every block meets every block of the stated queries; a task
holds one of each. What leaves a task are k rows for each query.
"""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import ship

LINES = 128
MISS = 0.05
# Half the window for radius 1: half of sqrt(8 c^2 ln c / (c^2 - 1)) for radii that grow by c = 2.
HALF_WINDOW = 2.719 / 2
FIRST_RADIUS = 0.25
BLOCK = 2048
QUERY_BLOCK = 2048
QUERY_EVERY = 50
_SEED = 20_231


def threshold(lines: int = LINES, miss: float = MISS) -> int:
    """Collisions that a vector at exactly the radius reaches but for probability ``miss``."""
    p = math.erf(HALF_WINDOW / math.sqrt(2))
    return max(1, math.floor(lines * p - NormalDist().inv_cdf(1 - miss) * math.sqrt(lines * p * (1 - p))))


class Block:
    """The sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / self.norms[:, None]
        self.unit = unit
        self.lines = np.random.default_rng([_SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], LINES))
        projected = (unit @ self.lines).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.place = np.empty(order.shape, kind)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=kind)[None, :], axis=1)

    def collisions(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, vectors): in how many arrays the vector lies in the query's window."""
        kind, count = self.place.dtype, np.zeros((len(queries), len(self.ids)), np.uint16)
        for line in range(LINES):
            low = np.searchsorted(self.sorted[line], queries[:, line] - HALF_WINDOW * radius)
            high = np.searchsorted(self.sorted[line], queries[:, line] + HALF_WINDOW * radius, "right")
            # Unsigned: what lies before the window wraps round to large numbers.
            inside = (self.place[line][None, :] - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
            full = (high - low) > np.iinfo(kind).max
            count += inside | full[:, None]
        return count

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(number of the query, vec_id, cosine) of the k nearest found for each query."""
        need = threshold()
        norms = np.sqrt((queries * queries).sum(axis=1))
        unit = queries / norms[:, None]
        projected = unit @ self.lines
        radius = np.full(len(queries), FIRST_RADIUS)
        best: dict[int, np.ndarray] = {}
        open_ = np.arange(len(queries))
        while len(open_):
            still = []
            for at in range(0, len(open_), 32):
                some = open_[at : at + 32]
                count = self.collisions(projected[some], radius[some])
                for q, row in zip(some, count):
                    everything = radius[q] >= 2
                    found = np.flatnonzero(self.ids != ids[q] if everything else (row >= need) & (self.ids != ids[q]))
                    near = self.unit[found] @ unit[q]
                    best[q] = found
                    if everything:
                        continue
                    far = math.inf
                    if len(found) >= k:
                        kth = np.partition(near, len(near) - k)[len(near) - k]
                        far = math.sqrt(max(0.0, 2 - 2 * kth))
                    if far > radius[q]:
                        # The k-th verified is a bound: within its distance lie k at least.
                        radius[q] = min(far * (1 + 1e-9), 2 * radius[q]) if far < math.inf else 2 * radius[q]
                        still.append(q)
            open_ = np.array(still, int)
        out = []
        for q in range(len(queries)):
            found = best[q]
            score = (self.vectors[found] * queries[q]).sum(axis=1) / (self.norms[found] * norms[q])
            for i in np.lexsort((self.ids[found], -score))[:k]:
                out.append((q, int(self.ids[found[i]]), float(score[i])))
        return out


def _usable(vector: str) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return good & F.exists(vector, lambda x: x != 0)


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _join_block(data: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(data) and len(queries):
        block = Block(data["vec_id"].to_numpy(np.int64), np.stack(data["v"].to_list()).astype(np.float64))
        ids, keys = queries["vec_id"].to_numpy(np.int64), queries["key"].to_numpy(np.int64)
        wanted = np.stack(queries["v"].to_list()).astype(np.float64)
        out = [(int(ids[q]), int(keys[q]), v, s) for q, v, s in block.search(ids, wanted, k)]
    found = pd.DataFrame(out, columns=["query_id", "key", "vec_id", "score"])
    return found.astype({"query_id": "int64", "key": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, k: int = 5, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``query_every`` its k nearest rows.

    ``vectors`` has vec_id and embedding (array of numbers) and any other columns. Null or zero vectors, vectors with null
    or non-finite components and rows without vec_id take no part; vectors of another dimension are no candidates.
    Rows that repeat id and vector count once; rows of the query's own id are no candidates. An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & _usable("v")).distinct()
    v = v.withColumn("key", F.xxhash64("v")).withColumn("dim", F.size("v"))
    n, n_queries = v.agg(F.count("*"), F.count_if(F.col("vec_id") % query_every == 0)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    data = v.select(
        "dim", F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).alias("block"),
        F.explode(_upto(query_blocks)).alias("query_block"), "vec_id", "v",
    )
    queries = v.filter(F.col("vec_id") % query_every == 0).select(
        "dim", F.explode(_upto(blocks)).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("query_block"), "vec_id", "key", "v",
    )
    keys = ["dim", "block", "query_block"]

    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _join_block(a, b, k)

    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(
        join, "query_id long, key long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
