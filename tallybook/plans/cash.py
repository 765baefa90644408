"""Bank-to-journal cash reconciliation."""

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.amounts import money_total, signed_amount
from tallybook.functions.labels import inclusion_flag, none_of
from tallybook.operators import matching
from tallybook.operators.entries import (
    event_entries,
    journal_lines,
    payment_entries,
    reconciled_bank_transactions,
)


@dataclass(frozen=True)
class CashTables:
    """Inputs of the cash reports.

    The event tables (payrolls, contractor payments, historical companies) are not among
    them: their ids are unique and no column of theirs is reported.
    """

    payment_records: DataFrame
    payment_record_entries: DataFrame
    record_groups: DataFrame
    groups: DataFrame
    bank_groups: DataFrame
    bank_transactions_raw: DataFrame
    journal: DataFrame


def cash_bank_transactions(
    tables: CashTables, start: datetime.date, end: datetime.date, excluded_owners: Sequence[int] = ()
) -> DataFrame:
    """Bank transactions behind the reconciled event entries of a date range."""
    combined = payment_entries(tables.payment_records, tables.payment_record_entries, start, end)
    return reconciled_bank_transactions(
        event_entries(combined, excluded_owners),
        tables.record_groups,
        tables.groups,
        tables.bank_groups,
        tables.bank_transactions_raw,
    )


def cash_journal_lines(listing: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """Journal lines of a date range in every date spelling."""
    return journal_lines(listing, start, end, mixed_dates=True)


def _sides(tables, start, end, excluded_owners):
    return (
        cash_bank_transactions(tables, start, end, excluded_owners),
        journal_lines(tables.journal, start, end),
    )


def cash_matches(
    tables: CashTables, start: datetime.date, end: datetime.date, excluded_owners: Sequence[int] = ()
) -> DataFrame:
    return matching.matched(*_sides(tables, start, end, excluded_owners))


def cash_unmatched_journal(
    tables: CashTables, start: datetime.date, end: datetime.date, excluded_owners: Sequence[int] = ()
) -> DataFrame:
    rows = matching.unmatched_journal(*_sides(tables, start, end, excluded_owners))
    return rows.select("bank_transaction_id", "je_bank_transaction_id", "je_account", "je_amount")


def cash_unmatched_bank(
    tables: CashTables, start: datetime.date, end: datetime.date, excluded_owners: Sequence[int] = ()
) -> DataFrame:
    rows = matching.unmatched_bank(*_sides(tables, start, end, excluded_owners)).filter(
        F.col("scenario") == matching.UNMATCHED_BANK
    )
    return rows.select("je_bank_transaction_id", "bank_transaction_id", "bt_account", "bt_amount")


def _records_by_category(
    records: DataFrame, entries: DataFrame, wanted: DataFrame, excluded_owners: Sequence[int]
) -> DataFrame:
    """Payment records filed under the wanted bank ids, per record and category."""
    chosen = records.join(
        wanted.toDF("_wanted").distinct(), F.col("bank_transaction_ids") == F.col("_wanted"), "left_semi"
    ).select(
        F.col("id").alias("record"), "origination_account_id", "bank_name", "bank_account", "bank_transaction_ids",
        "reconciled", "bank_transaction_date",
    )
    # Entries of the chosen records are summed per record first. Of the owner the flag only asks whether it
    # counts, so a record of very many entries shrinks to a few rows before the join.
    owner = F.col("on_behalf_of_id")
    counts = owner.isNotNull() & none_of(owner, excluded_owners)
    of_chosen = entries.join(
        chosen.select("record").distinct(), F.col("payment_record_id") == F.col("record"), "left_semi"
    )
    moved = of_chosen.groupBy(
        "payment_record_id", "transaction_category", F.coalesce(counts, F.lit(False)).alias("owner_counts")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(signed_amount(F.col("payment_direction"), F.col("amount"))).alias("net"),
    )
    flag = inclusion_flag(
        F.col("reconciled"), F.col("transaction_category"), F.col("bank_account"), F.col("bank_transaction_date"),
        F.col("owner_counts"),
    )
    return (
        chosen.join(moved, F.col("record") == F.col("payment_record_id"), "left")
        .groupBy(
            "origination_account_id", "bank_name", "bank_account", F.col("record").alias("payment_record_id"),
            "transaction_category", "bank_transaction_ids", flag.alias("exclusion_reason"),
        )
        .agg(
            # A record without entries is one row of the report.
            F.sum(F.coalesce(F.col("n"), F.lit(1))).alias("record_count"),
            money_total(F.coalesce(F.col("net"), F.lit(0))).alias("net_sum_amount"),
        )
    )


def unmatched_journal_by_category(
    tables: CashTables,
    start: datetime.date,
    end: datetime.date,
    excluded_owners: Sequence[int] = (),
    flagged_owners: Sequence[int] = (),
) -> DataFrame:
    """Payment records behind journal lines without bank transaction."""
    rows = matching.unmatched_journal(*_sides(tables, start, end, excluded_owners))
    return _records_by_category(
        tables.payment_records, tables.payment_record_entries, rows.select("je_bank_transaction_id"), flagged_owners
    )


def unmatched_bank_by_category(
    tables: CashTables,
    start: datetime.date,
    end: datetime.date,
    excluded_owners: Sequence[int] = (),
    flagged_owners: Sequence[int] = (),
) -> DataFrame:
    """Payment records behind bank transactions without journal line."""
    rows = cash_unmatched_bank(tables, start, end, excluded_owners)
    ids = rows.select(F.translate(F.col("bank_transaction_id").cast("string"), ",", ""))
    return _records_by_category(
        tables.payment_records, tables.payment_record_entries, ids, flagged_owners
    )
