"""Balances by owner, by account and by event."""

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.constants import BALANCE_TOLERANCE
from tallybook.functions.amounts import TOTAL, money_total
from tallybook.functions.keys import event_uid
from tallybook.functions.labels import none_of
from tallybook.operators.filters import id_list_filter, operating_account_filter
from tallybook.operators.running import running_balance


def accounting_balance_aggregates(
    ledger: DataFrame, until: datetime.date, has_negative_balance: bool, sort: bool = True
) -> DataFrame:
    """Balance per owner beyond the tolerance, for owners below zero or not, largest first.

    The report's first grouping (with floored dates and investigation columns) is summed
    up again by owner, so one grouping gives the same totals.
    """
    owners = (
        ledger.filter(F.col("bank_transaction_date") <= F.lit(until))
        .groupBy("pr_on_behalf_of_id", "on_behalf_of_name")
        .agg(money_total(F.col("balance")).alias("balance"))
        .filter(F.abs("balance") > BALANCE_TOLERANCE)
        .filter((F.col("balance") < 0) == F.lit(has_negative_balance))
    )
    return owners.orderBy(F.col("balance").desc(), "pr_on_behalf_of_id") if sort else owners


def accounting_balance_total(
    ledger: DataFrame, until: datetime.date, has_negative_balance: bool
) -> DataFrame:
    """Sum over :func:`accounting_balance_aggregates`, one row."""
    owners = accounting_balance_aggregates(ledger, until, has_negative_balance, sort=False)
    return owners.agg(money_total(F.col("balance")).alias("balance"))


def bank_balances_by_account(
    bank_transactions: DataFrame, until: datetime.date, excluded_accounts: Sequence[int] = ()
) -> DataFrame:
    """Signed sum per operating account and reconcile flag up to a date."""
    rows = operating_account_filter(bank_transactions).filter(
        (F.col("transaction_date") <= F.lit(until))
        & none_of(F.col("origination_account_id"), excluded_accounts)
    )
    return (
        rows.groupBy("bank_account", "origination_account_id", F.col("reconcile_flag").alias("reconciled"))
        .agg(money_total(F.col("transaction_signed_amount")).alias("signed_amount"))
        .orderBy("bank_account", "origination_account_id", "reconciled")
    )


def aging_first_negative(
    ledger: DataFrame, until: datetime.date, uids: Sequence[str] | DataFrame
) -> DataFrame:
    """First date on which the running balance of each listed event key is below zero.

    The list is applied before the running sum; it names whole keys, so sums do not change.
    """
    keyed = _in_event_range(ledger.filter(F.col("bank_transaction_date") <= F.lit(until)), uids).withColumn(
        "uid", event_uid(F.col("event_id"), F.col("transaction_category"))
    )
    daily = (
        id_list_filter(keyed, "uid", uids)
        .groupBy("uid", "pr_on_behalf_of_id", "bank_transaction_date")
        .agg(F.sum("balance").alias("balance"))
    )
    negative = running_balance(daily).filter(F.col("running_balance") < 0)
    # The smallest struct per key is its first row; this combines before the shuffle.
    first = F.min(F.struct("bank_transaction_date", "pr_on_behalf_of_id", "running_balance"))
    return (
        negative.groupBy("uid")
        .agg(first.alias("_first"))
        .select(
            "uid",
            F.col("_first.bank_transaction_date").alias("negative_balance_date"),
            F.col("_first.running_balance").cast(TOTAL).alias("running_balance"),
        )
    )


def _in_event_range(ledger: DataFrame, uids: Sequence[str] | DataFrame) -> DataFrame:
    """The part of the ledger between the smallest and the largest listed event, a filter that reaches the scan."""
    if isinstance(uids, DataFrame):
        return ledger
    heads = [uid.partition("x")[0] for uid in uids if uid is not None]
    events = [int(head) for head in heads if head.isascii() and head.removeprefix("-").isdigit()]
    return ledger.filter(F.col("event_id").between(min(events), max(events))) if events else ledger


def null_event_netting(ledger: DataFrame, until: datetime.date) -> DataFrame:
    """Negative balances of entries without event, per owner; their key is NULL by construction."""
    rows = ledger.filter((F.col("bank_transaction_date") <= F.lit(until)) & F.col("event_id").isNull())
    return (
        rows.groupBy(
            event_uid(F.col("event_id"), F.col("transaction_category")).alias("uid"),
            "pr_on_behalf_of_id",
            "event_id",
        )
        .agg(money_total(F.col("balance")).alias("balance"))
        .filter(F.col("balance") < -BALANCE_TOLERANCE)
    )
