"""Month-over-month netting of loss events."""

from collections.abc import Sequence
from dataclasses import dataclass

import datetime
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook import constants as K
from tallybook.functions.keys import normalize_key
from tallybook.operators.asof import snapshot_as_of
from tallybook.operators.joins import repeat_rows
from tallybook.operators.matching import with_population_counts
from tallybook.operators.populations import (
    exclusion_population,
    negative_event_balances,
    recovery_population,
)
from tallybook.params import Period

# Labels of the first month in order of precedence, then of the second.
MONTH_1_LABELS = ("recovery receivable matched", "bad debt matched", "excluded")
MONTH_1_DEFAULT = "unmatched"
RECOVERY, BAD_DEBT, EXCLUSION, UNCHANGED, CHANGED, PAID_OFF = (
    "Recovery Receivable",
    "Bad Debts",
    "Unchanged- matched to Exclusion",
    "Unchanged",
    "Unidentified Loss",
    "Paid Off",
)


@dataclass(frozen=True)
class NettingMonth:
    """Cutoff of the ledger and period of the dated tables."""

    cutoff: datetime.date
    period: Period


def recovery_keys(
    snapshot: DataFrame, period: Period, excluded_companies: Sequence[int], excluded_investigations: Sequence[int]
) -> DataFrame:
    """Event keys of the receivables of a period; a key of two receivables comes twice."""
    rows = recovery_population(
        snapshot, period.end, period.snapshot_date, excluded_companies, excluded_investigations
    )
    return rows.select(normalize_key(F.col("id_category_concat")).alias("uid"))


def bad_debt_keys(transfers: DataFrame, period: Period) -> DataFrame:
    """Event keys of pending bad debt effective by the period end, one row each.

    The report takes maxima per key after joins that only multiply rows of a key, so
    neither the joins nor an earlier DISTINCT change the result.
    """
    pending = snapshot_as_of(transfers, period.snapshot_date).filter(
        (F.col("fiscal_year_written_off") >= K.FISCAL_YEAR_FLOOR)
        & (F.col("effective_date") <= F.lit(period.end))
        & (F.col("override_status") == K.BAD_DEBT_OPEN_STATUS)
    )
    return pending.groupBy(normalize_key(F.col("id_category_concat")).alias("uid")).agg(
        F.max("bad_debt_id").alias("bad_debt_id"),
        F.max("bad_debt_amount").alias("bad_debt_amount"),
        F.max("payment_event_balance_amount").alias("p_e_amount"),
    )


def month_populations(
    snapshot: DataFrame,
    transfers: DataFrame,
    period: Period,
    excluded_companies: Sequence[int] = (),
    excluded_investigations: Sequence[int] = (),
) -> list[DataFrame]:
    """The three explanations of a negative event, in order of precedence."""
    return [
        recovery_keys(snapshot, period, excluded_companies, excluded_investigations),
        bad_debt_keys(transfers, period).select("uid"),
        exclusion_population(snapshot, period.end, period.snapshot_date).select("uid"),
    ]


def netting_analysis(
    ledger: DataFrame,
    snapshot: DataFrame,
    transfers: DataFrame,
    month_1: NettingMonth,
    month_2: NettingMonth,
    excluded_companies: Sequence[int] = (),
    excluded_investigations: Sequence[int] = (),
) -> DataFrame:
    """Negative events of month 1 that nothing explains, and what became of them in month 2.

    The ledger is read once for both cutoffs. Unexplained means absent from all three
    populations of month 1, which is an anti join; every join runs on ``uid``, the key the
    balances are already partitioned by.
    """
    both = negative_event_balances(ledger, month_1.cutoff, month_2.cutoff)
    open_events = both.filter(F.col("balance_1").isNotNull())
    explained = [
        month_populations(snapshot, transfers, month.period, excluded_companies, excluded_investigations)
        for month in (month_1, month_2)
    ]
    any_of_month_1 = functools.reduce(DataFrame.unionByName, [p.select("uid") for p in explained[0]]).distinct()
    open_events = open_events.join(any_of_month_1, "uid", "left_anti")
    result = with_population_counts(open_events, explained[1], null_uids=False)
    cases = [
        (F.col("_n_1") > 0, RECOVERY),
        (F.col("_n_2") > 0, BAD_DEBT),
        (F.col("_n_3") > 0, EXCLUSION),
        (F.col("balance_2") == F.col("balance_1"), UNCHANGED),
        (F.col("balance_2") != F.col("balance_1"), CHANGED),
    ]
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    rank = F.when(F.lit(False), F.lit(None).cast("int"))
    for number, (holds, name) in enumerate(cases, 1):
        label = label.when(holds, name)
        rank = rank.when(holds, number)
    placed = result.select(
        "uid",
        F.col("balance_1").alias("balance"),
        F.lit(MONTH_1_DEFAULT).alias("match"),
        F.lit(len(MONTH_1_LABELS) + 1).alias("match_priority"),
        label.otherwise(PAID_OFF).alias("second_match"),
        rank.otherwise(len(cases) + 1).alias("second_match_priority"),
        "_copies",
    )
    return repeat_rows(placed, "_copies")
