"""The cash chain: payment records, their entries, bank transactions and journal lines."""

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.constants import NON_EVENT_CATEGORIES
from tallybook.functions.amounts import bank_signed_amount, parse_paren_amount
from tallybook.functions.dates import parse_date_or_null, parse_mixed_date
from tallybook.functions.labels import none_of
from tallybook.operators.filters import operating_account_filter
from tallybook.operators.joins import left_join_repeating

ENTRY_COLUMNS = (
    "payment_record_id", "transaction_category", "event_id", "event_type", "on_behalf_of_id",
    "on_behalf_of_type", "payment_direction", "amount",
)


def between_dates(column: str, start: datetime.date, end: datetime.date) -> Column:
    return F.col(column).between(F.lit(start), F.lit(end))


def payment_entries(
    records: DataFrame, entries: DataFrame, start: datetime.date, end: datetime.date
) -> DataFrame:
    """Payment records of a date range with their entries; a record without entries is kept."""
    records = records.filter(between_dates("bank_transaction_date", start, end)).select(
        "id", "bank_transaction_date", "bank_account", "bank_transaction_ids", "reconciled",
        "transmission_type", "transaction_type", "payment_record_entries_sum",
    )
    entries = entries.select(*ENTRY_COLUMNS)
    return left_join_repeating(records, entries, [("id", "payment_record_id")], null_keys="never")


def event_entries(entries: DataFrame, excluded_owners: Sequence[int] = ()) -> DataFrame:
    """Reconciled entries of events on operating accounts, without transfers and invoices."""
    return operating_account_filter(entries).filter(
        F.col("reconciled")
        & none_of(F.col("transaction_category"), NON_EVENT_CATEGORIES)
        & F.col("event_id").isNotNull()
        & none_of(F.col("on_behalf_of_id"), excluded_owners)
    )


def reconciled_bank_transactions(
    entries: DataFrame,
    record_groups: DataFrame,
    groups: DataFrame,
    bank_groups: DataFrame,
    bank_transactions: DataFrame,
) -> DataFrame:
    """Distinct bank transactions tied to the entries through an active reconciliation group.

    Nothing but the bank transaction is returned, so each step is a semi join on
    de-duplicated keys and the many-to-many bridges never multiply rows.
    """
    records = entries.select(F.col("payment_record_id").alias("_record")).distinct()
    tied = record_groups.join(records, F.col("payment_record_id") == F.col("_record"), "left_semi")
    wanted = tied.select(F.col("reconciliation_group_id").alias("_group")).distinct()
    active = (
        groups.filter(F.col("state") == "active")
        .join(wanted, F.col("id") == F.col("_group"), "left_semi")
        .select(F.col("id").alias("_active"))
        .distinct()
    )
    banks = (
        bank_groups.join(active, F.col("reconciliation_group_id") == F.col("_active"), "left_semi")
        .select(F.col("bank_transaction_id").alias("_bank"))
        .distinct()
    )
    return (
        bank_transactions.join(banks, F.col("id") == F.col("_bank"), "left_semi")
        .select(
            F.col("id").alias("bank_transaction_id"),
            "date",
            "origination_account_id",
            bank_signed_amount(F.col("transaction_type"), F.col("amount")).alias("signed_amount"),
        )
        .distinct()
    )


def journal_lines(
    listing: DataFrame, start: datetime.date, end: datetime.date, mixed_dates: bool = False
) -> DataFrame:
    """Lines of the text journal in a date range.

    With ``mixed_dates`` all date spellings are read and the date column is a date;
    otherwise only ``MM/DD/YY`` counts and the text is passed on as it is.
    """
    parse = parse_mixed_date if mixed_dates else parse_date_or_null
    dated = listing.withColumn("_date", parse(F.col("bank_transaction_date"))).filter(
        between_dates("_date", start, end)
    )
    shown = F.col("_date") if mixed_dates else F.col("bank_transaction_date")
    return dated.select(
        parse_paren_amount(F.col("net_usd_amount")).alias("amount"),
        "je_number",
        "bank_transaction_id",
        "origination_account_id",
        shown.alias("bank_transaction_date"),
    )
