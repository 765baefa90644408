"""Matching of two or more populations."""

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.joins import left_join_spreading_nulls, repeat_rows

MATCHED = "Matched"
UNMATCHED_BANK = "Unmatched BT"
UNMATCHED_JOURNAL = "Unmatched JE"


def _bank_side(bank: DataFrame) -> DataFrame:
    return bank.select(
        "bank_transaction_id",
        F.col("bank_transaction_id").cast("string").alias("_bank_key"),
        F.col("date").alias("bt_date"),
        F.col("origination_account_id").alias("bt_account"),
        F.col("signed_amount").alias("bt_amount"),
    )


def _journal_side(journal: DataFrame) -> DataFrame:
    return journal.select(
        F.col("bank_transaction_id").alias("je_bank_transaction_id"),
        F.col("bank_transaction_date").alias("je_date"),
        F.col("origination_account_id").alias("je_account"),
        F.col("amount").alias("je_amount"),
        "je_number",
    )


def _with_scenario(df: DataFrame) -> DataFrame:
    in_bank = F.col("bank_transaction_id").isNotNull()
    in_journal = F.col("je_bank_transaction_id").isNotNull()
    scenario = (
        F.when(in_bank & in_journal, MATCHED).when(in_bank, UNMATCHED_BANK).when(in_journal, UNMATCHED_JOURNAL)
    )
    return df.select(
        "bank_transaction_id", "je_bank_transaction_id", "bt_date", "je_date", "bt_account", "je_account",
        "bt_amount", "je_amount", "je_number", scenario.alias("scenario"),
    )


def matched(bank: DataFrame, journal: DataFrame) -> DataFrame:
    """Journal lines with their bank transaction."""
    joined = _journal_side(journal).join(
        _bank_side(bank), F.col("je_bank_transaction_id") == F.col("_bank_key"), "inner"
    )
    return _with_scenario(joined)


def unmatched_bank(bank: DataFrame, journal: DataFrame) -> DataFrame:
    """Bank transactions no journal line names."""
    named = journal.select(F.col("bank_transaction_id").alias("_named")).distinct()
    left = _bank_side(bank).join(named, F.col("_bank_key") == F.col("_named"), "left_anti")
    empty = {
        "je_bank_transaction_id": F.lit(None).cast("string"),
        "je_date": F.lit(None).cast(journal.schema["bank_transaction_date"].dataType),
        "je_account": F.lit(None).cast("string"),
        "je_amount": F.lit(None).cast("decimal(18,2)"),
        "je_number": F.lit(None).cast("string"),
    }
    return _with_scenario(left.withColumns(empty))


def unmatched_journal(bank: DataFrame, journal: DataFrame) -> DataFrame:
    """Journal lines that name a bank transaction which is not there."""
    known = bank.select(F.col("bank_transaction_id").cast("string").alias("_known")).distinct()
    left = (
        _journal_side(journal)
        .filter(F.col("je_bank_transaction_id").isNotNull())
        .join(known, F.col("je_bank_transaction_id") == F.col("_known"), "left_anti")
    )
    empty = {
        "bank_transaction_id": F.lit(None).cast("long"),
        "bt_date": F.lit(None).cast("date"),
        "bt_account": F.lit(None).cast("int"),
        "bt_amount": F.lit(None).cast("decimal(18,2)"),
    }
    return _with_scenario(left.withColumns(empty))


# Unmatched bank transactions are spread over this many slots.
SLOTS = 256


def match_classify(bank: DataFrame, journal: DataFrame) -> DataFrame:
    """All rows of both sides with their scenario; NULL where neither side has an id.

    This is a full outer join, but Spark can split a hot key on the left of a left join, not one of a full join. So
    bank transactions first learn whether a line names them. Those that none names then wait in slots, where an empty
    line that is added for each slot meets them, and one left join of the lines gives all rows. The bank side, which
    is the result of a chain of joins, is planned once. Lines without an id are spread as well.
    """
    lines, banks = _journal_side(journal), _bank_side(bank)
    named = journal.select(F.col("bank_transaction_id").alias("_named")).distinct()
    known = banks.join(named, F.col("_bank_key") == F.col("_named"), "left")
    is_named = F.col("_named").isNotNull()
    slot = F.lit(1) + F.pmod(F.xxhash64("bank_transaction_id"), F.lit(SLOTS))
    waiting = known.select(
        *banks.columns, F.when(is_named, F.lit(0)).otherwise(slot).alias("_slot"), F.col("_named").alias("_wanted"),
        F.lit(True).alias("_there"),
    )
    key = F.col("je_bank_transaction_id")
    apart = -1 - F.pmod(F.xxhash64(*lines.columns), F.lit(SLOTS))
    slotted = lines.withColumn("_at", F.when(key.isNull(), apart).otherwise(F.lit(0).cast("long")))
    empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in lines.schema]
    with_empty = slotted.unionByName(bank.sparkSession.range(1, SLOTS + 1).select(*empty, F.col("id").alias("_at")))
    meets = (F.col("_at") == F.col("_slot")) & key.eqNullSafe(F.col("_wanted"))
    joined = with_empty.join(waiting, meets, "left").filter((F.col("_at") <= 0) | F.col("_there"))
    return _with_scenario(joined)


def priority_match(
    base: DataFrame,
    populations: Sequence[tuple[DataFrame, str]],
    default: str,
    label: str = "match",
    priority: str = "match_priority",
) -> DataFrame:
    """Label base rows by the first population that holds their ``uid``.

    Each population brings a ``uid`` column. A key that occurs n times in a population
    gives n rows, as the reports expect. Keys of all populations are counted together before
    one join, which meets one row per key, and the copies are made at the end, spread over tasks.
    """
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    rank = F.when(F.lit(False), F.lit(None).cast("int"))
    counted = with_population_counts(base, [population for population, _ in populations])
    for number, (_, name) in enumerate(populations, 1):
        text = text.when(F.col(f"_n_{number}") > 0, name)
        rank = rank.when(F.col(f"_n_{number}") > 0, number)
    labelled = counted.select(
        *base.columns,
        text.otherwise(default).alias(label),
        rank.otherwise(len(populations) + 1).cast("int").alias(priority),
        "_copies",
    )
    return repeat_rows(labelled, "_copies")


def with_population_counts(base: DataFrame, populations: Sequence[DataFrame], null_uids: bool = True) -> DataFrame:
    """``base`` with ``_n_1``, ``_n_2``..., the rows of each population with its ``uid``, and ``_copies``, what joins to all would make of a row.

    Populations are counted in one grouping, combined before its shuffle. Rows of ``base`` with a NULL ``uid`` match
    nothing and are spread; without them, a ``base`` partitioned by ``uid`` stays where it is.
    """
    tagged = [p.select(F.col("uid").alias("_uid"), F.lit(n).alias("_of")) for n, p in enumerate(populations, 1)]
    numbers = range(1, len(populations) + 1)
    counts = (
        functools.reduce(DataFrame.unionByName, tagged)
        .filter(F.col("_uid").isNotNull())
        .groupBy("_uid")
        .agg(*[F.count(F.when(F.col("_of") == n, 1)).alias(f"_n_{n}") for n in numbers])
    )
    copies = functools.reduce(operator.mul, [F.greatest(F.coalesce(f"_n_{n}", F.lit(0)), F.lit(1)) for n in numbers])
    if null_uids:
        joined = left_join_spreading_nulls(base, counts, [("uid", "_uid")])
    else:
        joined = base.join(counts, F.col("uid") == F.col("_uid"), "left")
    return joined.withColumn("_copies", copies.cast("long")).drop("_uid")
