"""Money movement: monthly movement, transfers in transit, FX revenue, payrolls, penalties."""

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook import constants as K
from tallybook.functions.amounts import money_total, zero_if_null
from tallybook.functions.dates import settlement_timing
from tallybook.functions.keys import text_id
from tallybook.functions.labels import first_match_like, like_none, none_of
from tallybook.operators.joins import left_join_repeating, left_join_spreading_nulls, polymorphic_join


def monthly_movement_by_category(
    records: DataFrame,
    start: datetime.date,
    end: datetime.date,
    own_company_id: int,
    split_account: str,
    ignored_records: Sequence[int] = (),
    ignored_transfers: Sequence[int] = (),
    mitigation_bank_ids: Sequence[int] = (),
) -> DataFrame:
    """Pay-out, pay-in and net per account, type and category, in five overlapping branches.

    ``split_account`` is reported in branches of its own. One scan tags each record with the branches it belongs to; each branch is grouped on
    its own, so a record of two branches is reported in both, as the report's union does.
    """
    account = F.col("bank_account")
    owner = F.col("on_behalf_of_id")
    operating = like_none(account, K.NON_OPERATING_SHORT_PATTERNS)
    split = account == split_account
    own = split & (owner == own_company_id)
    branches = [
        operating & (account != split_account) & none_of(F.col("id"), ignored_records),
        operating & split & (owner != own_company_id),
        operating & own,
        operating
        & own
        & F.col("transaction_type").isin(list(K.MOVEMENT_TRANSFER_TYPES))
        & F.col("signed_amount").between(-K.MOVEMENT_TRANSFER_LIMIT, K.MOVEMENT_TRANSFER_LIMIT)
        & none_of(F.col("id"), ignored_transfers),
        own
        & F.col("bank_transaction_ids").isin([str(i) for i in mitigation_bank_ids])
        & (F.col("payment_category") == "Others"),
    ]
    tags = F.array_compact(F.array(*[F.when(held, F.lit(n)) for n, held in enumerate(branches, 1)]))
    tagged = records.filter(
        F.col("reconciled") & F.col("bank_transaction_date").between(F.lit(start), F.lit(end))
    ).select(
        F.explode(tags).alias("branch"), "bank_account", "origination_account_id", "transaction_type",
        "payment_category", "credit_amount", "debit_amount", "signed_amount",
    )

    def rounded(amount: str) -> Column:
        return F.round(F.sum(zero_if_null(F.col(amount))), 2).cast("decimal(28,2)")

    return (
        tagged.groupBy(
            "branch",
            "bank_account",
            F.concat("bank_account", F.lit("-"), F.col("origination_account_id").cast("string")).alias(
                "bank_account_name"
            ),
            "transaction_type",
            "payment_category",
        )
        .agg(
            rounded("credit_amount").alias("payout"),
            rounded("debit_amount").alias("payin"),
            rounded("signed_amount").alias("reconciled_payment_records"),
        )
        .drop("branch")
        .orderBy("bank_account_name", "transaction_type", "payment_category")
    )


def _transfer_side(
    records: DataFrame,
    entries: DataFrame,
    companies: DataFrame,
    prefix: str,
    condition: Column,
    excluded_owners: Sequence[int],
    excluded_accounts: Sequence[int],
) -> DataFrame:
    side = records.filter(
        F.col("reconciled")
        & F.col("payment_record_entries_sum").isNotNull()
        & none_of(F.col("on_behalf_of_id"), excluded_owners)
        & none_of(F.col("origination_account_id"), excluded_accounts)
        & condition
    ).select(
        "id", "on_behalf_of_id", F.col("date").cast("date").alias("record_date"), "bank_transaction_date",
        "bank_account", "origination_account_id", "transmission_type", "signed_amount",
    )
    moved = entries.filter(F.col("transaction_category").isin(list(K.TRANSFER_CATEGORIES))).select(
        "payment_record_id", "event_id", "event_type"
    )
    keys = [
        "id", "on_behalf_of_id", "record_date", "bank_transaction_date", "event_id", "event_type", "bank_account",
        "origination_account_id", "transmission_type",
    ]
    # The company name follows from its id, so it is looked up after the sum.
    summed = (
        side.join(moved, F.col("id") == F.col("payment_record_id"), "inner")
        .groupBy(*keys)
        .agg(money_total(F.col("signed_amount")).alias("amount"))
    )
    if companies is not None:
        names = companies.select(F.col("id").alias("_company"), F.col("name").alias("on_behalf_of_name"))
        summed = left_join_spreading_nulls(summed, names, [("on_behalf_of_id", "_company")])
    shown = {
        "record_date": f"{prefix}_pr_date",
        "id": f"{prefix}_pr_id",
        "bank_transaction_date": f"{prefix}_bank_transaction_date",
        "bank_account": f"{prefix}_bank_account",
        "origination_account_id": f"{prefix}_origination_account_id",
        "transmission_type": f"{prefix}_transmission_type",
        "amount": f"{prefix}_amount",
    }
    return summed.withColumnsRenamed(shown)


def deposits_in_transit(
    records: DataFrame,
    entries: DataFrame,
    companies: DataFrame,
    period_end: datetime.date,
    excluded_owners: Sequence[int] = (),
    excluded_accounts: Sequence[int] = (),
) -> DataFrame:
    """Own transfers sent on the period end and not received by then."""
    end = F.lit(period_end)
    sent = _transfer_side(
        records, entries, companies, "origination",
        (F.col("transmission_type") == K.ORIGINATION_TRANSMISSION) & (F.col("bank_transaction_date") == end),
        excluded_owners, excluded_accounts,
    )
    received = (
        _transfer_side(
            records, entries, None, "destination",
            (F.col("transmission_type") == K.DESTINATION_TRANSMISSION) & (F.col("bank_transaction_date") >= end),
            excluded_owners, excluded_accounts,
        )
        .filter(F.col("destination_pr_date") >= F.lit(period_end - datetime.timedelta(days=K.TRANSFER_LOOKBACK_DAYS)))
        .withColumnsRenamed({"event_id": "_event_id", "event_type": "_event_type"})
        .withColumn("_opposite", (-F.col("destination_amount")).cast("decimal(28,2)"))
        .drop("on_behalf_of_id")
    )
    joined = left_join_repeating(
        sent,
        received,
        [("event_id", "_event_id"), ("event_type", "_event_type"), ("origination_amount", "_opposite")],
        null_keys="together",
    )
    arrival = F.col("destination_bank_transaction_date")
    return joined.filter(arrival.isNull() | (arrival > end)).select(
        text_id(F.col("on_behalf_of_id")).alias("on_behalf_of_id"),
        "on_behalf_of_name",
        "event_id",
        *[
            f"{side}_{name}"
            for side in ("origination", "destination")
            for name in (
                "pr_date", "pr_id", "bank_transaction_date", "bank_account", "origination_account_id",
                "transmission_type", "amount",
            )
        ],
        settlement_timing(arrival, period_end).alias("settlement_timing"),
        (zero_if_null(F.col("origination_amount")) + zero_if_null(F.col("destination_amount")))
        .cast("decimal(28,2)")
        .alias("event_balance"),
    )


def fx_markup_revenue(
    facts: DataFrame,
    fact_entries: DataFrame,
    contractor_payments: DataFrame,
    start: datetime.date,
    end: datetime.date,
) -> DataFrame:
    """FX revenue per company, payment and date with the payment's currency and USD amount."""
    records = facts.filter(
        F.col("reconciled_flag") & F.col("bank_transaction_date").between(F.lit(start), F.lit(end))
    ).select(F.col("payment_record_id").alias("_record"), "on_behalf_of_id", "bank_transaction_date")
    revenue = fact_entries.filter(F.col("transaction_category") == "FX Revenue")
    markups = (
        revenue.join(records, F.col("payment_record_id") == F.col("_record"), "inner")
        .groupBy(
            text_id(F.col("on_behalf_of_id")).alias("pr_comp_id"),
            F.col("event_id").alias("contractor_payment_id"),
            F.col("bank_transaction_date").alias("reporting_date"),
        )
        .agg(money_total(F.col("payment_record_entry_signed_amount")).alias("markup_amount"))
    )
    payments = contractor_payments.select(
        F.col("id").alias("_payment"), "credit_currency", F.col("usd_amount").alias("contractor_payment_usd")
    )
    return left_join_spreading_nulls(markups, payments, [("contractor_payment_id", "_payment")]).select(
        "pr_comp_id", "contractor_payment_id", "reporting_date", "credit_currency", "contractor_payment_usd",
        "markup_amount",
    )


def paid_payroll_by_month(
    payrolls: DataFrame, month: datetime.date, start: datetime.date = K.PAYROLL_START
) -> DataFrame:
    """Gross amount of the paid payrolls of one month."""
    following = (month.replace(day=1) + datetime.timedelta(days=32)).replace(day=1)
    # A range on the plain column reaches the scan, unlike a comparison of truncated dates.
    paid = payrolls.filter(
        (F.col("processing_state") == "paid")
        & (F.col("check_date") >= F.lit(max(month, start)))
        & (F.col("check_date") < F.lit(following))
    )
    return paid.groupBy(F.trunc("check_date", "month").alias("month")).agg(
        money_total(F.col("gross_amount")).alias("gross_amount")
    )


# Rules of the penalty report: column, pattern, name of the label.
PENALTY_RULES = (
    ("agent_payment_type", "%State tax%", "tax"),
    ("agent_payment_type", "%Federal tax%", "tax"),
    ("agent_payment_type", "%Benefits Payment%", "benefits"),
    ("penalty_case_title", "%#ATO%", "takeover"),
)
PENALTY_LABELS = {
    "tax": "no_reclass - tax operations",
    "benefits": "requires_reclass - benefits operations",
    "takeover": "requires_reclass - risk operations",
    "default": "requires_reclass - default",
}


def penalty_accounting_mapping(labels=PENALTY_LABELS) -> Column:
    """Accounting label of a penalty row by agent payment type, then case title."""
    return first_match_like(
        [(F.col(column), pattern, labels[name]) for column, pattern, name in PENALTY_RULES], labels["default"]
    )


def penalty_group_inquiry(
    groups: DataFrame,
    cases: DataFrame,
    agents: DataFrame,
    entries: DataFrame,
    transmissions: DataFrame,
    nacha_entries: DataFrame,
    nacha_batches: DataFrame,
    reconciliations: DataFrame,
    statement: DataFrame,
    start: datetime.date,
    end: datetime.date,
    labels=PENALTY_LABELS,
) -> DataFrame:
    """Penalty groups down to the bank transactions that paid them, with accounting mapping.

    The report wants NACHA transmissions whose bank date lies in the range. That rejects
    every row without bank transaction, so the joins on the way there are inner joins,
    and of the record types only the batch can match. Joins to tables of unique ids that
    add no column (agent payments, files, returns, cheques) are not made.
    """
    paid = (
        statement.filter(F.col("date").between(F.lit(start), F.lit(end)))
        .select(F.col("id").alias("bank_id"), "bank_account", F.col("date").alias("bank_transaction_date"))
        .join(
            reconciliations.filter(F.col("record_type") == "NachaBatch").select("record_id", "record_type", "transaction_id"),
            F.col("bank_id") == F.col("transaction_id"),
            "inner",
        )
        .drop("bank_id", "transaction_id")
    )
    sent = (
        transmissions.filter(F.col("transmission_type") == "NachaEntry")
        .join(
            nacha_entries.select(F.col("id").alias("entry"), "nacha_batch_id", F.col("amount").alias("ne_amount")),
            F.col("transmission_id") == F.col("entry"),
            "inner",
        )
        .join(
            nacha_batches.select(F.col("id").alias("batch"), "entry_description", "total_credit", "total_debit"),
            F.col("nacha_batch_id") == F.col("batch"),
            "inner",
        )
    )
    settled = polymorphic_join(sent, paid, [("batch", "NachaBatch")], how="inner")
    penalties = entries.select(
        F.col("id").alias("entry_key"), F.col("penalty_group_id").alias("group_key"), "company_id",
        "penalized_agent_payment_id", "penalty_amount", "interest_amount",
    )
    heads = groups.select(
        F.col("id").alias("penalty_group_id"), "penalty_case_id", F.col("created_at").cast("date").alias("created_at"),
        F.col("pay_to").alias("penalty_group_pay_to"),
    )
    titles = cases.select(
        F.col("id").alias("case_key"), "agent_id", F.col("title").alias("penalty_case_title"),
        F.col("error_type").alias("penalty_case_error_type"), "quarter", "year",
    )
    names = agents.select(F.col("id").alias("agent_key"), F.col("name").alias("agent_name"), "agent_payment_type")
    full = (
        settled.join(penalties, F.col("penalty_entry_id") == F.col("entry_key"), "inner")
        .join(heads, F.col("group_key") == F.col("penalty_group_id"), "inner")
    )
    full = left_join_spreading_nulls(full, titles, [("penalty_case_id", "case_key")])
    full = left_join_spreading_nulls(full, names, [("agent_id", "agent_key")])
    return full.select(
        "penalty_group_id",
        "created_at",
        "penalty_case_title",
        "agent_name",
        "agent_payment_type",
        "quarter",
        "year",
        "penalty_group_pay_to",
        text_id(F.col("company_id")).alias("company_id"),
        text_id(F.col("penalized_agent_payment_id")).alias("penalized_agent_payment_id"),
        "penalty_amount",
        "interest_amount",
        "penalty_case_error_type",
        text_id(F.col("transmission_id")).alias("transmission_id"),
        "transmission_type",
        "ne_amount",
        "entry_description",
        text_id(F.col("batch")).alias("nacha_batch_id"),
        "total_credit",
        "total_debit",
        "bank_account",
        "bank_transaction_date",
        penalty_accounting_mapping(labels).alias("accounting_mapping"),
    )
