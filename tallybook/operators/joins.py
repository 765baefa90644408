"""Joins that need more than one call of ``DataFrame.join``."""

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# NULL keys never match, yet all of them hash to one partition. They are spread over this many.
NULL_KEY_SLICES = 256


def left_join_spreading_nulls(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]
) -> DataFrame:
    """Left outer equi-join to a side with few rows per key, scattering left rows with a NULL key.

    ``on`` pairs a left column with a right column; the names of both sides must not
    clash. The slice of a row follows from its content, so a retried task repeats it. A
    frequent key on the left is split at run time; for one on the right see
    :func:`left_join_repeating`.
    """
    left_keys = [F.col(name) for name, _ in on]
    some_null = F.lit(False)
    for key in left_keys:
        some_null = some_null | key.isNull()
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    spread = left.withColumn(
        "_slice", F.when(some_null, F.pmod(row_hash, F.lit(NULL_KEY_SLICES))).otherwise(F.lit(0).cast("long"))
    )
    # Always 0, but computed from the key so that the optimizer keeps it as a join key.
    fixed = right.withColumn("_right_slice", F.pmod(F.xxhash64(*[F.col(r) for _, r in on]), F.lit(1)))
    condition = F.col("_slice") == F.col("_right_slice")
    for left_name, right_name in on:
        condition = condition & (F.col(left_name) == F.col(right_name))
    return spread.join(fixed, condition, "left").drop("_slice", "_right_slice")


def left_join_repeating(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], null_keys: str = "apart"
) -> DataFrame:
    """Left outer equi-join to a side where one key may hold any share of the rows.

    Spark splits a frequent key on the right of an inner join at run time, but not on the right of an outer one. So
    the right side is completed: keys that only the left has get a row of NULLs. Then one inner join gives all rows.
    Only the key columns of ``left`` are planned a second time.

    ``null_keys`` says what becomes of left rows with a NULL in their key, which match nothing. ``apart``: they are
    read on their own, best where ``left`` is a scan, whose file statistics then rule most files out. ``together``: they
    pass through the join as a key of its own, best where ``left`` is the result of work. ``never``: there are none,
    and one is an error.
    """
    left_keys, right_keys = [name for name, _ in on], [f"_key_{n}" for n in range(len(on))]
    some_null = functools.reduce(operator.or_, [F.col(name).isNull() for name in left_keys])
    keyed = left.select(*[F.col(name).alias(k) for name, k in zip(left_keys, right_keys)])
    if null_keys == "apart":
        keyed = keyed.dropna()
    elif null_keys == "never":
        error = F.raise_error(F.lit(f"a key of {', '.join(left_keys)} is NULL"))
        keyed = keyed.select(*[F.when(F.col(k).isNull(), error).otherwise(F.col(k)).alias(k) for k in right_keys])
    elif null_keys != "together":
        raise ValueError(f"unsupported treatment of NULL keys {null_keys!r}")
    known = right.select(*[F.col(r).alias(k) for (_, r), k in zip(on, right_keys)]).dropna()
    if null_keys == "together":
        # Of a side that is only asked for distinct keys Spark leaves out the outer joins behind its other columns.
        keyed, known = keyed.distinct(), known.distinct()
    missing = _left_only(keyed, known)
    keys_of = {r: k for (_, r), k in zip(on, right_keys)}
    nothing = {field.name: F.lit(None).cast(field.dataType).alias(field.name) for field in right.schema}
    payload = [name for name in right.columns if name not in keys_of]
    # Each key is carried once, so that tables bucketed by it stay so.
    matching = right.dropna(subset=list(keys_of)).select(
        *payload, *[F.col(r).alias(k) for r, k in keys_of.items()], F.lit(True).alias("_found")
    )
    completed = matching.unionByName(missing.select(*[nothing[name] for name in payload], *right_keys, F.lit(False).alias("_found")))
    pairs = list(zip(left_keys, right_keys))
    condition = _equal(pairs)
    if null_keys == "together":
        condition = functools.reduce(operator.and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])
    restored = [
        F.when(F.col("_found"), F.col(keys_of[f.name])).cast(f.dataType).alias(f.name) if f.name in keys_of else F.col(f.name)
        for f in right.schema
    ]
    joined = left.join(completed, condition, "inner").select(*left.columns, *restored)
    return joined.unionByName(left.filter(some_null).select("*", *nothing.values())) if null_keys == "apart" else joined


def _left_only(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """The keys, once each, of the first that the second, of the same columns, does not have."""
    both = keyed.withColumn("_left_only", F.lit(True)).unionByName(known.withColumn("_left_only", F.lit(False)))
    return both.groupBy(*keyed.columns).agg(F.min("_left_only").alias("_left_only")).filter("_left_only").drop("_left_only")


def _equal(on: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for left_name, right_name in on:
        condition = condition & (F.col(left_name) == F.col(right_name))
    return condition


# Copies of a row that one task makes at a time.
COPIES_TOGETHER = 10_000


def repeat_rows(df: DataFrame, copies: str, together: int = COPIES_TOGETHER) -> DataFrame:
    """Emit each row as often as the column says, many copies of a row by several tasks.

    A row is first multiplied by the number of its chunks, then chunks are dealt out, and each is multiplied by its
    size, so neither a task nor an array holds all copies of a frequent row.
    """
    chunks = F.ceil(F.col(copies) / F.lit(together)).cast("long")
    numbered = df.withColumn("_chunk", F.explode(F.sequence(F.lit(1).cast("long"), chunks)))
    dealt = numbered.repartition(*[F.col(f"`{name}`") for name in numbered.columns])
    inside = F.least(F.lit(together).cast("long"), F.col(copies) - (F.col("_chunk") - 1) * together)
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), inside))).drop(
        "_chunk", "_copy", copies
    )


def credit_loss_lookup(
    receivables: DataFrame, credit: DataFrame, key: Column, credit_key: Column
) -> DataFrame:
    """Attach ``is_credit_loss`` from the distinct (key, flag) rows; several flags fan out."""
    flags = credit.select(credit_key.alias("_credit_key"), "is_credit_loss").distinct()
    keyed = receivables.withColumn("_key", key)
    return left_join_spreading_nulls(keyed, flags, [("_key", "_credit_key")]).drop("_key", "_credit_key")


def investigation_with_category(
    investigations: DataFrame, bridge: DataFrame, event_balances: DataFrame, how: str = "left"
) -> DataFrame:
    """Investigations with the transaction category of their event balances."""
    links = bridge.select(
        F.col("payment_investigation_id").alias("_investigation"),
        F.col("payment_event_balance_id").alias("_balance_id"),
    )
    categories = event_balances.select(F.col("id").alias("_id"), "transaction_category")
    # Bridge and balances first: the balance id is unique, so this join does not grow.
    if how == "inner":
        named = links.join(categories, F.col("_balance_id") == F.col("_id"), "inner").drop("_id", "_balance_id")
        return investigations.join(named, F.col("id") == F.col("_investigation"), "inner").drop("_investigation")
    # Investigations without a link get one to no balance before the balances are joined, so each of the joins is planned once.
    error = F.raise_error(F.lit("an id of an investigation is NULL"))
    asked = investigations.select(F.when(F.col("id").isNull(), error).otherwise(F.col("id")).alias("_investigation"))
    links = links.dropna(subset=["_investigation"])
    unlinked = _left_only(asked, links.select("_investigation")).withColumn(
        "_balance_id", F.lit(None).cast(links.schema["_balance_id"].dataType)
    )
    completed = links.unionByName(unlinked)
    named = left_join_spreading_nulls(completed, categories, [("_balance_id", "_id")]).drop("_id", "_balance_id")
    return investigations.join(named, F.col("id") == F.col("_investigation"), "inner").drop("_investigation")


def polymorphic_join(
    left: DataFrame, records: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "left"
) -> DataFrame:
    """Join on ``(record_id, record_type)`` equal to any of several (key column, type) pairs.

    The OR of equalities becomes one equi-join: every left row lists the pairs it has a key for and is joined once
    per pair. For a left join only the distinct tuples of keys are listed and find their records; then the left rows,
    moved once, meet the records of their tuple.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    if len({record_type for _, record_type in pairs}) < len(pairs):
        raise ValueError("each record type may be listed once")
    record_columns = [c for c in records.columns if c not in ("record_id", "record_type")]
    records = records.filter(F.col("record_type").isin([record_type for _, record_type in pairs]))
    records = records.withColumnsRenamed({"record_id": "_record_id", "record_type": "_record_type"})
    wanted = F.array_compact(
        F.array(
            *[
                F.when(F.col(key).isNotNull(), F.struct(F.col(key).cast("long").alias("id"), F.lit(record_type).alias("type")))
                for key, record_type in pairs
            ]
        )
    )
    same_record = (F.col("_want.id") == F.col("_record_id")) & (F.col("_want.type") == F.col("_record_type"))
    # Inner joins, so that a frequent record on either side is split at run time.
    if how == "inner":
        return (
            left.withColumn("_want", F.explode(wanted)).join(records, same_record, "inner").select(*left.columns, *record_columns)
        )
    keys = list(dict.fromkeys(key for key, _ in pairs))
    tuples = left.select(*keys).distinct()
    listed = F.concat_ws("|", *[F.coalesce(F.col(key).cast("long").cast("string"), F.lit("")) for key in keys])
    resolved = (
        tuples.select(listed.alias("_tuple"), F.explode(wanted).alias("_want"))
        .join(records, same_record, "inner")
        .select("_tuple", *record_columns)
    )
    keyed = left.withColumn("_keys", listed)
    return left_join_repeating(keyed, resolved, [("_keys", "_tuple")], null_keys="never").drop("_keys", "_tuple")
