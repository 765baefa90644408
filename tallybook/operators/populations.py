"""Populations of the receivable snapshot and of the event ledger."""

import datetime
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook import constants as K
from tallybook.functions.amounts import TOTAL, money_total
from tallybook.functions.keys import event_uid, normalize_key
from tallybook.functions.labels import none_of


def in_period(period_end: datetime.date, snapshot_date: datetime.date) -> Column:
    return (F.col("snapshot_date") == F.lit(snapshot_date)) & (
        F.col("bank_transaction_date") == F.lit(period_end)
    )


def recovery_rows(
    snapshot: DataFrame,
    periods: Sequence[tuple[datetime.date, datetime.date]],
    excluded_companies: Sequence[int] = (),
    excluded_investigations: Sequence[int] = (),
) -> DataFrame:
    """Open receivables of the given (period end, snapshot date) pairs, duplicates kept."""
    return snapshot.filter(reduce(or_, [in_period(*p) for p in periods])).filter(
        F.col("company_id").isNotNull()
        & none_of(F.col("company_id"), excluded_companies)
        & none_of(F.col("accounting_status_mapping"), (K.MAPPING_WRITTEN_OFF, K.MAPPING_FALSE_POSITIVE))
        & none_of(F.col("pi_id"), excluded_investigations)
        & (F.col("pi_category").isNull() | (F.col("pi_category") != K.MICRO_VARIANCE))
        # A recovered case still counts while its balance has come back to zero or above.
        & ((F.col("pi_status") != "recovered") | (F.col("current_balance") >= 0))
        & F.col("pi_status").isNotNull()
    )


def recovery_population(
    snapshot: DataFrame,
    period_end: datetime.date,
    snapshot_date: datetime.date,
    excluded_companies: Sequence[int] = (),
    excluded_investigations: Sequence[int] = (),
) -> DataFrame:
    """Distinct open receivables of one period."""
    return recovery_rows(
        snapshot, [(period_end, snapshot_date)], excluded_companies, excluded_investigations
    ).distinct()


def exclusion_population(
    snapshot: DataFrame, period_end: datetime.date, snapshot_date: datetime.date
) -> DataFrame:
    """Balance per event key that the receivable report leaves out, by status or as micro variance.

    The two conditions cannot hold for one row, so one pass takes both.
    """
    by_status = F.col("pi_status").isin(list(K.EXCLUDED_STATUSES))
    micro = (F.col("pi_category") == K.MICRO_VARIANCE) & ~by_status
    return (
        snapshot.filter(in_period(period_end, snapshot_date))
        .filter(by_status | micro)
        .groupBy(normalize_key(F.col("id_category_concat")).alias("uid"))
        .agg(money_total(F.col("balance")).alias("balance"))
    )


def negative_event_balances(ledger: DataFrame, *cutoffs: datetime.date) -> DataFrame:
    """Negative balance per event key at each cutoff, in columns ``balance_1``, ``balance_2`` ...

    Owners of one event are judged one by one, then added. All cutoffs share one scan and
    one shuffle; a column is NULL where the event is not negative at that cutoff.
    """
    totals = ledger.filter(F.col("bank_transaction_date") <= F.lit(max(cutoffs)))
    totals = totals.withColumn("uid", event_uid(F.col("event_id"), F.col("transaction_category")))
    per_owner = (
        totals.filter(F.col("uid").isNotNull())
        .groupBy("uid", "pr_on_behalf_of_id")
        .agg(
            *[
                F.sum(F.when(F.col("bank_transaction_date") <= F.lit(cutoff), F.col("balance"))).alias(f"owner_{n}")
                for n, cutoff in enumerate(cutoffs, 1)
            ]
        )
    )
    negative = [F.col(f"owner_{n}") < -K.BALANCE_TOLERANCE for n in range(1, len(cutoffs) + 1)]
    return (
        per_owner.filter(reduce(or_, negative))
        .groupBy("uid")
        .agg(
            *[
                F.sum(F.when(below, F.col(f"owner_{n}"))).cast(TOTAL).alias(f"balance_{n}")
                for n, below in enumerate(negative, 1)
            ]
        )
    )
