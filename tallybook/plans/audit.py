"""Audit look-ups: money movement of chosen events, transactions and references."""

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.amounts import money_total, signed_amount, signed_amount_else_negative
from tallybook.functions.keys import event_uid, text_id
from tallybook.operators.filters import id_list_filter, operating_account_filter
from tallybook.operators.joins import left_join_spreading_nulls
from tallybook.constants import NON_CUSTOMER_CASH_PATTERNS


def account_balance_event_history(
    ledger: DataFrame, company_id: int, until: datetime.date
) -> DataFrame:
    """Ledger rows of one company up to a date, newest first."""
    return ledger.filter(
        (F.col("pr_on_behalf_of_id") == company_id) & (F.col("bank_transaction_date") <= F.lit(until))
    ).orderBy(F.col("bank_transaction_date").desc(), "event_id", "transaction_category", "balance")


def event_history(
    entries: DataFrame,
    records: DataFrame,
    nacha_entries: DataFrame,
    companies: DataFrame,
    event_ids: Sequence[int] | DataFrame,
    category: str,
) -> DataFrame:
    """All money movement of the listed events in one transaction category."""
    chosen = id_list_filter(entries.filter(F.col("transaction_category") == category), "event_id", event_ids).select(
        "payment_record_id", "event_id", F.col("on_behalf_of_id").alias("entry_owner"), "transaction_category",
        "payment_direction", "amount",
    )
    moved = chosen.join(
        records.filter(F.col("reconciled")), F.col("payment_record_id") == F.col("id"), "inner"
    ).drop("id")
    # Sum first: everything the report groups by, except two looked-up names, is known here.
    keys = [
        "entry_owner", "event_id", "transaction_category", "transaction_type", "transmission_type",
        "transmission_id", "bank_transaction_date", "bank_transaction_ids", "bank_account", "on_behalf_of_id",
    ]
    summed = moved.groupBy(*keys).agg(
        money_total(signed_amount(F.col("payment_direction"), F.col("amount"))).alias("amount")
    )
    batches = nacha_entries.select(F.col("id").alias("_entry"), "nacha_batch_id")
    names = companies.select(F.col("id").alias("_company"), F.col("name").alias("company_name"))
    with_batch = summed.withColumn(
        "_nacha_entry", F.when(F.col("transmission_type") == "NachaEntry", F.col("transmission_id"))
    )
    with_batch = left_join_spreading_nulls(with_batch, batches, [("_nacha_entry", "_entry")])
    named = left_join_spreading_nulls(with_batch, names, [("on_behalf_of_id", "_company")])
    return (
        named.groupBy(
            "company_name",
            text_id(F.col("entry_owner")).alias("company_id"),
            text_id(F.col("event_id")).alias("event_id"),
            "transaction_category",
            "transaction_type",
            "transmission_type",
            text_id(F.col("nacha_batch_id")).alias("nacha_batch_id"),
            text_id(F.col("transmission_id")).alias("pr_transmission_id"),
            "bank_transaction_date",
            "bank_transaction_ids",
            "bank_account",
        )
        .agg(money_total(F.col("amount")).alias("amount"))
        .orderBy("bank_transaction_date", "pr_transmission_id", "event_id", "company_id")
    )


def vouch_by_bank_transaction(
    entries: DataFrame, records: DataFrame, bank_transaction_ids: str
) -> DataFrame:
    """Signed sum of the entries filed under one bank-transaction text."""
    chosen = records.filter(F.col("bank_transaction_ids") == bank_transaction_ids).select(
        "id", F.col("on_behalf_of_id").alias("record_owner"), "transaction_type", "transmission_type",
        "transmission_id", "bank_transaction_date", "bank_transaction_ids", "bank_account",
    )
    moved = entries.join(chosen, F.col("payment_record_id") == F.col("id"), "inner")
    return moved.groupBy(
        text_id(F.col("record_owner")).alias("company_id"),
        text_id(F.col("event_id")).alias("event_id"),
        "transaction_type",
        "transmission_type",
        text_id(F.col("transmission_id")).alias("pr_transmission_id"),
        "transaction_category",
        event_uid(F.col("event_id"), F.col("transaction_category")).alias("concatenate"),
        "bank_transaction_date",
        "bank_transaction_ids",
        "bank_account",
    ).agg(money_total(signed_amount(F.col("payment_direction"), F.col("amount"))).alias("amount"))


def invoices_in_customer_cash(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Signed invoice amounts that sit in customer-cash accounts."""
    invoices = entries.filter(F.col("transaction_category") == "Invoices")
    accounts = operating_account_filter(
        records.filter(F.col("reconciled")), patterns=NON_CUSTOMER_CASH_PATTERNS
    ).select("id", "bank_account", "transmission_id", "transmission_type")
    return (
        invoices.join(accounts, F.col("payment_record_id") == F.col("id"), "inner")
        .groupBy("bank_account", "transmission_id", "transmission_type")
        .agg(
            money_total(signed_amount_else_negative(F.col("payment_direction"), F.col("amount"))).alias(
                "signed_amount"
            )
        )
    )


def _raw_with_statement(raw: DataFrame, statement: DataFrame) -> DataFrame:
    shown = statement.select(
        F.col("id").alias("_id"),
        F.col("date").alias("statement_date"),
        "bank_account",
        F.col("type_description").alias("statement_type"),
        "signed_amount",
    )
    return raw.join(shown, F.col("id") == F.col("_id"), "inner")


def bank_reference_lookup(raw: DataFrame, statement: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Bank reference of listed bank transactions."""
    return _raw_with_statement(id_list_filter(raw, "id", ids), statement).select(
        "id",
        F.col("statement_type").alias("type_description"),
        "bank_account",
        "signed_amount",
        F.date_trunc("day", F.col("statement_date")).cast("date").alias("bank_transaction_date"),
        "description",
        "bank_reference",
    )


def bank_reference_trace(
    raw: DataFrame, statement: DataFrame, references: Sequence[str] | DataFrame, bank_account: str
) -> DataFrame:
    """Distinct transactions of one account by listed bank references."""
    chosen = statement.filter(F.col("bank_account") == bank_account)
    return (
        _raw_with_statement(id_list_filter(raw, "bank_reference", references), chosen)
        .select(
            "bank_account",
            "id",
            F.col("statement_date").alias("date"),
            "description",
            "type_description",
            "bank_reference",
            "signed_amount",
        )
        .distinct()
    )
