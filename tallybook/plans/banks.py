"""Bank side: account list, breakdowns, sweeps, cheques, statement export."""

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.amounts import bank_side, bank_signed_cents, money_total, signed_amount_else_null, zero_if_null
from tallybook.functions.labels import account_label_with_fallback, mapped_label
from tallybook.operators.filters import operating_account_filter
from tallybook.operators.joins import left_join_spreading_nulls


def bank_account_list(accounts: DataFrame, restricted: DataFrame) -> DataFrame:
    """Account dimension with the restricted columns joined in."""
    numbers = restricted.select(
        F.col("origination_account_id").alias("_account"), "routing_number", "account_number"
    )
    return (
        accounts.join(numbers, F.col("origination_account_id") == F.col("_account"), "left")
        .select(
            "origination_account_id",
            F.col("origination_bank_name").alias("bank"),
            F.col("account_purpose").alias("purpose"),
            F.concat("origination_bank_name", F.lit(" "), "account_purpose").alias("combined"),
            "account_type",
            F.col("account_effective_from_ts").cast("date").alias("effective_from"),
            "closed_flag",
            "routing_number",
            "account_number",
        )
        .orderBy("origination_account_id")
    )


def _breakdown(payments: DataFrame, calendar: DataFrame, labels: Mapping[int, str]) -> DataFrame:
    """Volume and record count per month, account and transmission type.

    ``payments``: payment_record_id, bank_transaction_date, origination_account_id,
    transmission_type, volume. Months sort by their text, latest letter first.
    """
    days = calendar.select(F.col("date").alias("_day"), "month_name", "year")
    return (
        payments.join(days, F.col("bank_transaction_date") == F.col("_day"), "inner")
        .groupBy(
            F.concat("month_name", F.lit(" "), F.col("year").cast("string")).alias("time"),
            mapped_label(F.col("origination_account_id"), labels).alias("bank"),
            "origination_account_id",
            "transmission_type",
        )
        .agg(
            money_total(F.col("volume")).alias("total_volume"),
            F.countDistinct("payment_record_id").alias("total_count"),
        )
        .orderBy(F.col("time").desc(), "bank", "origination_account_id", "transmission_type")
    )


def _in_range(calendar: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    # Spark derives the same range for the payments from the join on the date.
    return calendar.filter(F.col("date").between(F.lit(start), F.lit(end)))


def breakdown_records(
    records: DataFrame,
    raw: DataFrame,
    calendar: DataFrame,
    start: datetime.date,
    end: datetime.date,
    labels: Mapping[int, str],
) -> DataFrame:
    """Breakdown over payment records whose amounts sit in the raw table."""
    amounts = raw.filter(F.col("origination_account_id").isin(list(labels))).select(
        F.col("id").alias("_raw_id"), "origination_account_id", "transmission_type", F.col("amount").alias("volume")
    )
    payments = records.select(F.col("id").alias("payment_record_id"), "bank_transaction_date").join(
        amounts, F.col("payment_record_id") == F.col("_raw_id"), "inner"
    )
    return _breakdown(payments, _in_range(calendar, start, end), labels)


def breakdown_facts(
    facts: DataFrame,
    calendar: DataFrame,
    start: datetime.date,
    end: datetime.date,
    labels: Mapping[int, str],
) -> DataFrame:
    """Breakdown over the one payment fact table; volume is debit plus credit."""
    payments = facts.filter(F.col("origination_account_id").isin(list(labels))).withColumn(
        "volume", zero_if_null(F.col("debit_amount")) + zero_if_null(F.col("credit_amount"))
    )
    return _breakdown(payments, _in_range(calendar, start, end), labels)


def sweep_account_transactions(
    raw: DataFrame, start: datetime.date, end: datetime.date, account_id: int, pattern: str
) -> DataFrame:
    """Sweeps of one account by description pattern: signed cents and side."""
    rows = raw.filter(
        F.col("date").between(F.lit(start), F.lit(end))
        & (F.col("origination_account_id") == account_id)
        & F.col("description").like(pattern)
    )
    return (
        rows.groupBy("id", "date", "description", bank_side(F.col("transaction_type")).alias("debit_credit_accgt"))
        .agg(F.sum(bank_signed_cents(F.col("transaction_type"), F.col("amount"))).alias("amount_cents"))
        .orderBy("id", "date")
    )


def bank_statement_export(
    raw: DataFrame,
    statement: DataFrame,
    bank_accounts: Sequence[str],
    origination_accounts: Sequence[int],
    start: datetime.date,
    end: datetime.date,
) -> DataFrame:
    """Bank-statement fields of every transaction of the chosen accounts and dates."""
    chosen = statement.filter(
        F.col("bank_account").isin(list(bank_accounts)) & F.col("date").between(F.lit(start), F.lit(end))
    )
    codes = raw.filter(F.col("origination_account_id").isin(list(origination_accounts))).select(
        F.col("id").alias("bank_transaction_id"), "origination_account_id", "bank_reference",
        "customer_reference", F.col("type_code").alias("bai_type_code"), "description",
    )
    return (
        chosen.join(codes, F.col("id") == F.col("bank_transaction_id"), "inner")
        .select(
            "bank_account", "origination_account_id", "payment_method", "bank_transaction_id", "type_description",
            "date", "debit_amount", "credit_amount", "signed_amount", "bank_reference", "customer_reference",
            "bai_type_code", "description",
        )
        .orderBy("bank_account", "date", "bank_reference", "bank_transaction_id")
    )


def outstanding_checks(
    check_entries: DataFrame,
    checks: DataFrame,
    records: DataFrame,
    records_raw: DataFrame,
    accounts: DataFrame,
    banks: DataFrame,
    reconciliations: DataFrame,
    statement: DataFrame,
    period_end: datetime.date,
    labels: Mapping[int, str],
) -> DataFrame:
    """Sent cheques printed by the period end that the bank has not cleared by then; ``labels`` name some accounts otherwise."""
    end = F.lit(period_end)
    sent = checks.filter((F.col("processing_state") == "sent") & (F.col("print_date") <= end)).select(
        F.col("id").alias("check_id"), "payment_date", F.col("description").alias("check_description"), "number",
        "amount", "payment_direction", "deposit_date", "processing_state",
    )
    entries = check_entries.select(F.col("id").alias("entry_id"), "check_payment_id")
    # The account filter rejects a missing payment record, so that join is an inner one.
    paid = operating_account_filter(records.filter(F.col("transmission_type") == "CheckPaymentEntry")).select(
        F.col("id").alias("record_id_"), "transmission_id"
    )
    raw = records_raw.select(F.col("id").alias("raw_id"), "origination_account_id")
    cleared = statement.select(
        F.col("id").alias("bank_id"), F.col("date").alias("bt_date"), F.round("signed_amount", 2).cast("decimal(18,2)").alias("bt_amount")
    )
    # Where the cheque cleared: reconciliations of sent cheques meet the bank.
    clearing = left_join_spreading_nulls(
        reconciliations.filter(F.col("record_type") == "CheckPayment")
        .select("record_id", "transaction_id")
        .join(sent.select("check_id"), F.col("record_id") == F.col("check_id"), "left_semi"),
        cleared,
        [("transaction_id", "bank_id")],
    ).select(F.col("record_id").alias("cleared_check"), "bt_date", "bt_amount").distinct()
    account_names = accounts.join(
        banks.select(F.col("id").alias("_bank"), F.col("name").alias("bank_name")),
        F.col("origination_bank_id") == F.col("_bank"),
        "left",
    ).select(
        F.col("id").alias("_account"),
        account_label_with_fallback(F.col("id"), F.col("bank_name"), F.col("purpose"), labels).alias("bank_account"),
    )
    return (
        sent.join(entries, F.col("check_id") == F.col("check_payment_id"), "inner")
        .join(paid, F.col("entry_id") == F.col("transmission_id"), "inner")
        .join(raw, F.col("record_id_") == F.col("raw_id"), "left")
        .join(account_names, F.col("origination_account_id") == F.col("_account"), "left")
        .join(clearing, F.col("check_id") == F.col("cleared_check"), "left")
        .filter(F.col("bt_date").isNull() | (F.col("bt_date") > end))
        .select(
            "bank_account",
            F.col("check_id").alias("check_payment_id"),
            F.col("payment_date").alias("check_date"),
            F.col("check_description").alias("description"),
            F.col("number").alias("printed_check_no"),
            signed_amount_else_null(F.col("payment_direction"), F.col("amount")).alias("cp_amount"),
            "deposit_date",
            "processing_state",
            "bt_date",
            "bt_amount",
        )
        .distinct()
    )
