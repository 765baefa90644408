"""Mixing sources to target word counts by entropy balancing.

Each document gets a rate w, the number of times it is wanted. Among all rates between 0 and ``MOST`` whose words sum
to the source's target, entropy balancing takes those of least Kullback-Leibler divergence from 1. They are the
exponentially tilted rates ``min(MOST, exp(lam * size / mean size))``. ``lam`` minimises the convex dual: its gradient
is the gap between words and target, and Newton steps, kept inside a bracket, bring it to zero.
Documents of one source and size have one rate, so the sums run over (source, size, number), grouped from all documents.

Rates become copies: every document gets the whole part, and of the fractions f documents are drawn in the order
of u / f, with u a hash of the document as a number in (0, 1), until the target is met as nearly as a whole document allows
(sequential Poisson sampling). The place where the draw stops is found from sums over bins and the rows of one bin.
At last one document in each source may gain or lose a copy if that brings the sum closer.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import SPACES, Scratch, text_or_empty

MOST = 2.0
SHARE = 1.5
WEIGHTS = (3, 1, 2)
TOLERANCE = 1e-5
ROUNDS = 60
# Bins of u / f, each 1 / BINS wide; the last takes all from LAST on.
BINS = 1024
LAST = 4
_CLASH = "_mix_"


def words(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(f"[^{SPACES}]+")).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target. Sources in code point order, null last, take the weights in turn.

    A target never exceeds ``most`` times its source's size; what is above goes to the others by weight. That is the
    level at which ``min(most * size, weight * level)`` sums to the share, found from the order of the caps.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.get(listed, nth % len(weights))).withColumn("cap", F.col("source_size") * most)
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"),
        (F.sum("source_size").over(everything) * share).alias("goal"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    # The level if exactly the sources before this one are capped; right at the first that stays below its cap.
    level = (F.col("goal") - F.col("capped")) / (F.col("all_weight") - F.col("gone"))
    by = by.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    by = by.withColumn("level", F.first("level", ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    reached = F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))
    return by.select("source", "source_size", F.least(reached, F.col("cap")).alias("target"))


def _tilt(scratch: Scratch, counted: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """source, source_size, target, mean, lam: the Newton iterations."""
    seen = counted.filter("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    top = F.lit(math.log(most)) * F.col("mean") / F.col("least")
    state = goals.join(seen, goals["source"].eqNullSafe(seen["source"]), "left").select(
        goals["*"],
        "mean",
        F.when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), top).otherwise(0.0).alias("lam"),
        F.when(F.col("target") < F.col("source_size"), F.lit(float("-inf"))).otherwise(0.0).alias("low"),
        F.when(F.col("target") < F.col("source_size"), F.lit(0.0)).otherwise(top).alias("high"),
        (F.col("mean").isNull() | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))).alias("done"),
    )
    state = scratch.keep(state, "tilt")
    for _ in range(ROUNDS):
        if not state.filter("NOT done").head(1):
            break
        x, c = F.col("lam") * F.col("size") / F.col("mean"), F.col("size") / F.col("mean")
        rate = F.least(F.lit(most), F.exp(F.least(x, F.lit(700.0))))
        tokens = F.col("size") * F.col("n") * rate
        open_ = state.filter("NOT done").select(F.col("source").alias("s"), "lam", "mean")
        sums = (
            counted.filter("size > 0")
            .join(open_, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(tokens).alias("got"), F.sum(F.when(x < math.log(most), tokens * c).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        state = scratch.keep(
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumns({"low": low, "high": high})
            .withColumn("step", F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope")))
            .select(
                "source", "source_size", "target", "mean",
                F.when(F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target")), F.col("lam"))
                .when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step"))
                .when(F.col("low") == float("-inf"), F.col("high") * 2 - 1)
                .otherwise((F.col("low") + F.col("high")) / 2).alias("lam"),
                "low", "high",
                (F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target"))).alias("done"),
            ),
            "tilt",
        )
    return state.select("source", "source_size", "target", "mean", "lam")


def _rated(docs: DataFrame, tilt: DataFrame, most: float) -> DataFrame:
    """``docs`` (source, size, u, ...) with whole and part, the whole and fractional rate, and key, the draw's order."""
    rate = F.least(F.lit(most), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))))
    t = tilt.withColumnRenamed("source", "_s")
    joined = docs.join(t, docs["source"].eqNullSafe(t["_s"])).drop("_s")
    rated = joined.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    key = F.when((F.col("part") > 0) & (F.col("size") > 0), F.col("u") / F.col("part"))
    return rated.withColumn("key", key).drop("rate", "part")


def _drawn(column: str = "stop") -> Column:
    return (F.col("whole") + F.coalesce((F.col("key") <= F.col(column)).cast("long"), F.lit(0))).cast("long")


def _stops(scratch: Scratch, rated: DataFrame, tilt: DataFrame) -> DataFrame:
    """tilt with ``stop``: documents with a key up to it get one copy more."""
    width = F.least(F.floor(F.col("key") * BINS), F.lit(LAST * BINS)).cast("int")
    binned = rated.withColumn("bin", width)
    sums = scratch.keep(
        binned.groupBy("source", "bin").agg(
            F.sum(F.col("size") * F.col("whole")).alias("whole"), F.sum("size").alias("held")
        ),
        "bins",
    )
    need = sums.groupBy("source").agg(F.sum("whole").alias("whole")).withColumnRenamed("source", "_s")
    need = need.join(tilt.select("source", "target"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "_s", (F.col("target") - F.col("whole")).alias("need")
    )
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.filter("bin IS NOT NULL").select(
        "source", "bin", (F.sum("held").over(by_bin) - F.col("held")).alias("before"), F.sum("held").over(by_bin).alias("to")
    )
    at = running.join(need, F.col("source").eqNullSafe(F.col("_s"))).filter("before <= need AND to > need")
    at = at.select("_s", F.col("bin").alias("_bin"), "before", "need")
    in_bin = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = binned.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_bin")))
    rows = rows.withColumn("upto", F.col("before") + F.sum("size").over(in_bin))
    kept = rows.groupBy("_s").agg(
        F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("need"), F.col("key"))).alias("inside"),
        F.first("_bin").alias("_bin"),
    )
    # Nothing of the bin is taken: stop just before it. No bin is cut: all are taken, or none.
    stop = F.coalesce(F.col("inside"), F.col("_bin") / F.lit(BINS) - 1e-12)
    kept = kept.select("_s", stop.alias("stop"))
    none = need.filter("need > 0").select(F.col("_s").alias("_n"), F.lit(float("inf")).alias("all"))
    full = tilt.join(kept, F.col("source").eqNullSafe(F.col("_s")), "left")
    full = full.join(none, F.col("source").eqNullSafe(F.col("_n")), "left")
    return full.select(*tilt.columns, F.coalesce("stop", "all", F.lit(-1.0)).alias("stop"))


def _flip(scratch: Scratch, rated: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """plan with flip (a document's hash) and by (+1, -1): the one change that brings the source closest to its target."""
    p = plan.select(F.col("source").alias("_s"), "target", "stop")
    drawn = rated.drop("target", "stop").join(p, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", _drawn())
    got = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got")).withColumnRenamed("source", "_g")
    gap = plan.join(got, F.col("source").eqNullSafe(F.col("_g"))).select("_g", (F.col("target") - F.col("got")).alias("gap"))
    gap = scratch.keep(gap, "gaps")
    change = F.when((F.col("gap") > 0) & (F.col("copies") + 1 <= most), 1).when(
        (F.col("gap") < 0) & (F.col("copies") > 0), -1
    )
    after = F.abs(F.col("gap") - change * F.col("size"))
    best = (
        drawn.join(gap, F.col("source").eqNullSafe(F.col("_g")))
        .withColumn("by", change)
        .filter(F.col("by").isNotNull() & (F.col("size") > 0) & (after < F.abs("gap")))
        .groupBy("_g")
        .agg(F.min(F.struct(after.alias("after"), F.col("id").alias("flip"), F.col("by").alias("by"))).alias("b"))
    )
    return plan.join(best, F.col("source").eqNullSafe(F.col("_g")), "left").select(*plan.columns, "b.flip", "b.by")


def _sized(docs: DataFrame) -> DataFrame:
    # 53 bits of a hash of the document as a number in (0, 1).
    uniform = (F.shiftrightunsigned("id", 11) + F.lit(0.5)) / F.lit(float(2**53))
    return docs.withColumns({"size": words(), "id": F.xxhash64("doc_id", text_or_empty())}).withColumn("u", uniform)


def _planned(docs: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(_sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    counted = scratch.keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    totals = counted.select("source", (F.col("size") * F.col("n")).alias("size"))
    tilt = _tilt(scratch, counted, scratch.keep(targets(totals, share, weights, most), "targets"), most)
    rated = _rated(sized, tilt, most)
    plan = scratch.keep(_stops(scratch, rated, tilt), "stops")
    return scratch.keep(_flip(scratch, rated, plan, most), "flips")


def _copies(docs: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """``docs`` with size, source_size, target and copies; one row's copies follow from itself and its source's plan."""
    rated = _rated(docs, plan, most)
    flipped = F.coalesce(F.when(F.col("id") == F.col("flip"), F.col("by")), F.lit(0))
    return rated.withColumn("copies", _drawn() + flipped)


def mix(
    docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row of ``docs`` (doc_id, text, source, others).

    Null text has no words. Documents without words get one copy of nothing. Rows that repeat doc_id and text get
    the same number of copies. A null source is a source of its own. An empty table gives no rows.
    """
    plan = _planned(docs, share, weights, most)
    copies = _copies(_sized(docs.select("doc_id", "text", "source")).drop("text"), plan, most)
    return copies.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"
    )


def mixed(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all its columns."""
    plan = _planned(docs, share, weights, most)
    names = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    # Other columns go aside, as their names may clash with those above.
    aside = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(_CLASH + str(i)) for i, c in enumerate(names)])
    copies = _copies(_sized(aside), plan, most)
    repeated = copies.select("*", F.explode(F.expr("IF(copies > 0, sequence(1L, copies), array())")))
    back = {_CLASH + str(i): c for i, c in enumerate(names)}
    order = {c: (c if c in ("doc_id", "text", "source") else _CLASH + str(names.index(c))) for c in docs.columns}
    return repeated.select(*[F.col(order[c]).alias(back.get(order[c], c)) for c in docs.columns])
