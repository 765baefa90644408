"""Recovery receivables, their journals, and bad debt."""

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook import constants as K
from tallybook.functions.amounts import TOTAL, signed_amount
from tallybook.functions.dates import age_in_days, padded_month, unpadded_month
from tallybook.functions.keys import normalize_key, text_id
from tallybook.functions.labels import (
    accounting_status,
    aging_bucket,
    investigation_category,
    loss_category,
    loss_category_strict,
    none_of,
    reserve_flag,
    writeoff_category,
    yn_flag,
)
from tallybook.operators.asof import scd2_as_of, scd2_as_of_after_go_live, snapshot_as_of
from tallybook.operators.filters import operating_account_filter
from tallybook.operators.joins import (
    credit_loss_lookup,
    investigation_with_category,
    left_join_repeating,
    left_join_spreading_nulls,
)
from tallybook.operators.populations import recovery_population, recovery_rows
from tallybook.params import Period

RECEIVABLE_COLUMNS = (
    "event_type", "transaction_category", "pi_id", "pi_status", "pi_category", "pi_age_in_days",
    "accounting_to_reserve", "accounting_status_mapping", "accounting_pi_category", "balance", "current_balance",
)


def recovery_receivable_fy23(
    records: DataFrame,
    entries: DataFrame,
    investigations: DataFrame,
    investigations_raw: DataFrame,
    bridge: DataFrame,
    event_balances: DataFrame,
    period_end: datetime.date,
    excluded_owners: Sequence[int] = (),
    false_positive_ids: Sequence[int] = (),
) -> DataFrame:
    """Event balances negative at the period end, with their investigation and its status."""
    # The report drops rows without owner or of excluded owners in the end; owners are a
    # grouping column, so dropping them first gives the same groups.
    moved = entries.filter(
        none_of(F.col("transaction_category"), K.NON_EVENT_CATEGORIES)
        & F.col("event_id").isNotNull()
        & F.col("on_behalf_of_id").isNotNull()
        & none_of(F.col("on_behalf_of_id"), excluded_owners)
    ).select(
        "payment_record_id", "event_id", F.col("on_behalf_of_id").alias("owner"), "event_type",
        "transaction_category", "payment_direction", "amount",
    )
    cases = investigations_raw.filter(F.col("status").isNotNull()).select(
        F.col("id").alias("pi_id"), "status", F.col("created_at").alias("pi_creation_date")
    )
    dated = investigations.select(
        "id", F.col("event_id").alias("_event_id"), F.col("event_type").alias("_event_type"),
        F.col("category").alias("pi_category"),
        age_in_days(F.col("created_at"), F.lit(period_end)).alias("pi_age_in_days"),
    )
    with_category = investigation_with_category(dated, bridge, event_balances, how="inner").withColumnRenamed(
        "transaction_category", "_category"
    )
    known = cases.join(with_category, F.col("pi_id") == F.col("id"), "inner")
    reconciled = operating_account_filter(records.filter(F.col("reconciled"))).select("id", "bank_transaction_date")
    amount = signed_amount(F.col("payment_direction"), F.col("amount"))
    by_then = F.col("bank_transaction_date") <= F.lit(period_end)
    # Events, types and categories are group keys, so entries that no investigation asks for need not be grouped.
    wanted = known.select(
        F.col("_event_id").alias("_event"), F.col("_event_type").alias("_type"), F.col("_category").alias("_of_category")
    ).distinct()
    asked_for = (
        (F.col("event_id") == F.col("_event"))
        & (F.col("event_type") == F.col("_type"))
        & (F.col("transaction_category") == F.col("_of_category"))
    )
    balances = (
        moved.join(wanted, asked_for, "left_semi")
        .join(reconciled, F.col("payment_record_id") == F.col("id"), "inner")
        .groupBy("event_id", "owner", "event_type", "transaction_category")
        .agg(
            F.sum(F.when(by_then, amount).otherwise(F.lit(0))).cast(TOTAL).alias("peb_balance_amount"),
            F.sum(amount).cast(TOTAL).alias("current_balance_amount"),
        )
        .filter(F.col("peb_balance_amount") < 0)
    )
    same_event = (
        (F.col("event_id") == F.col("_event_id"))
        & (F.col("transaction_category") == F.col("_category"))
        & (F.col("event_type") == F.col("_event_type"))
    )
    age = F.col("pi_age_in_days")
    return (
        balances.join(known, same_event, "inner")
        .select(
            text_id(F.col("event_id")).alias("event_id"),
            text_id(F.col("owner")).alias("company_id"),
            "event_type",
            "transaction_category",
            "pi_id",
            "status",
            "pi_category",
            "pi_age_in_days",
            reserve_flag(age).alias("accounting_to_reserve"),
            accounting_status(
                F.col("current_balance_amount"), F.col("status"), F.col("pi_id"), age, false_positive_ids
            ).alias("accounting_status_mapping"),
            investigation_category(F.col("pi_category")).alias("accounting_pi_category"),
            "peb_balance_amount",
            "current_balance_amount",
            "pi_creation_date",
        )
        .distinct()
    )


def recovery_receivable_additions(
    snapshot: DataFrame,
    credit: DataFrame,
    previous: Period,
    current: Period,
    now: datetime.datetime,
    quarter_end: datetime.date,
    excluded_companies: Sequence[int] = (),
    excluded_investigations: Sequence[int] = (),
) -> DataFrame:
    """Receivables of the current period against those of the previous one.

    A receivable reaches its reserve age at the hour of ``now``; the quarter ends at the
    first moment of its last day, so past midnight that day itself no longer counts.
    """
    key = normalize_key(F.col("id_category_concat"))
    rows = recovery_rows(
        snapshot, [(current.end, current.snapshot_date)], excluded_companies, excluded_investigations
    )
    current_rows = (
        credit_loss_lookup(
            rows, snapshot_as_of(credit, current.snapshot_date), key, normalize_key(F.col("id_event_concat"))
        )
        .select(
            key.alias("concat"),
            text_id(F.col("event_id")).alias("event_id"),
            text_id(F.col("company_id")).alias("company_id"),
            *RECEIVABLE_COLUMNS,
            loss_category(F.col("accounting_pi_category"), F.col("is_credit_loss")).alias("updated_category"),
            aging_bucket(F.col("pi_age_in_days")).alias("aging_bucket"),
        )
        .distinct()
    )
    # Whole distinct rows: two different rows of one key give two result rows.
    before = recovery_population(
        snapshot, previous.end, previous.snapshot_date, excluded_companies, excluded_investigations
    ).select(
        key.alias("_previous"),
        F.col("accounting_to_reserve").alias("_reserve"),
        F.col("balance").alias("_balance"),
    )
    days_left = F.lit(K.RESERVE_AGE_DAYS) - F.col("pi_age_in_days")
    days_until = F.when(days_left < 0, F.lit(0)).otherwise(days_left)
    reached_on = F.date_add(F.lit(now.date()), days_until)
    in_time = reached_on <= F.lit(quarter_end) if now.time() == datetime.time() else reached_on < F.lit(quarter_end)
    is_new = F.col("_previous").isNull()
    return left_join_repeating(current_rows, before, [("concat", "_previous")], null_keys="together").select(
        *current_rows.columns,
        yn_flag(is_new, "Yes", "No").alias("new_in_rr2"),
        F.when(is_new, "New in Current Period").otherwise(F.col("_reserve")).alias("reserve_status_in_pp"),
        F.when(~is_new, F.col("balance") - F.col("_balance")).otherwise(F.lit(0)).cast(TOTAL).alias("balance_change"),
        days_until.alias("days_until_90_days"),
        yn_flag(in_time, "Yes", "No").alias("will_reach_90_days_aged_this_quarter"),
    )


def _receivable_report(
    snapshot, credit, investigations, period, excluded_companies, excluded_investigations, key, credit_key, extra
) -> DataFrame:
    # The final DISTINCT makes an earlier one needless: two equal inputs give equal results.
    rows = recovery_rows(
        snapshot, [(period.end, period.snapshot_date)], excluded_companies, excluded_investigations
    ).select("id_category_concat", "event_id", "company_id", *RECEIVABLE_COLUMNS)
    flagged = credit_loss_lookup(rows, snapshot_as_of(credit, period.snapshot_date), key, credit_key)
    created = investigations.select(F.col("id").alias("_pi"), F.col("created_at").alias("pi_created_at"))
    return (
        left_join_spreading_nulls(flagged, created, [("pi_id", "_pi")])
        .select(
            normalize_key(F.col("id_category_concat")).alias("id_category_concat"),
            text_id(F.col("event_id")).alias("event_id"),
            text_id(F.col("company_id")).alias("company_id"),
            *RECEIVABLE_COLUMNS,
            "pi_created_at",
            *extra,
            aging_bucket(F.col("pi_age_in_days")).alias("aging_bucket"),
        )
        .distinct()
    )


def loss_exposure(
    snapshot: DataFrame,
    credit: DataFrame,
    investigations: DataFrame,
    period: Period,
    excluded_companies: Sequence[int] = (),
    excluded_investigations: Sequence[int] = (),
) -> DataFrame:
    """Receivables with the month their loss is recognised: fraud at once, others after 90 days."""
    created = F.col("pi_created_at")
    later = created + F.expr("INTERVAL '90' DAY")
    recognised = F.when(F.col("accounting_pi_category") == "Fraud", padded_month(created)).otherwise(
        padded_month(later)
    )
    return _receivable_report(
        snapshot, credit, investigations, period, excluded_companies, excluded_investigations,
        F.col("id_category_concat"), F.col("id_event_concat"),
        [
            padded_month(created).alias("pi_mm_yyyy"),
            recognised.alias("loss_recog_mm_yyyy"),
            loss_category(F.col("accounting_pi_category"), F.col("is_credit_loss")).alias("updated_category"),
        ],
    )


def recovery_receivable_journal(
    snapshot: DataFrame,
    credit: DataFrame,
    investigations: DataFrame,
    period: Period,
    excluded_companies: Sequence[int] = (),
    excluded_investigations: Sequence[int] = (),
) -> DataFrame:
    """Receivables for the journal, with the month of their investigation."""
    return _receivable_report(
        snapshot, credit, investigations, period, excluded_companies, excluded_investigations,
        normalize_key(F.col("id_category_concat")), normalize_key(F.col("id_event_concat")),
        [
            unpadded_month(F.col("pi_created_at")).alias("pi_month_year"),
            loss_category_strict(F.col("accounting_pi_category"), F.col("is_credit_loss")).alias("updated_category"),
        ],
    )


def _written_off(transfers: DataFrame, until: datetime.date) -> DataFrame:
    return transfers.filter(
        (F.col("written_off_fiscal_year") >= K.FISCAL_YEAR_FLOOR) & (F.col("effective_date") <= F.lit(until))
    )


def recovery_charge_offs(
    transfer_history: DataFrame,
    debt_history: DataFrame,
    credit: DataFrame,
    investigations: DataFrame,
    bridge: DataFrame,
    event_balances: DataFrame,
    period: Period,
    go_live: datetime.date,
    partner_reason: str,
    partner_label: str,
) -> DataFrame:
    """Bad-debt transfers as they stood on a date, with notes, write-off category and investigation."""
    transfers = _written_off(scd2_as_of(transfer_history, period.snapshot_date), period.end)
    notes = scd2_as_of_after_go_live(debt_history, period.snapshot_date, go_live).select(
        F.col("bad_debt_id").alias("_debt"), "notes"
    )
    noted = left_join_spreading_nulls(transfers, notes, [("bad_debt_id", "_debt")]).withColumn(
        "id_category_concat", normalize_key(F.col("event_id_transaction_category_concat"))
    )
    flags = credit.select(
        normalize_key(F.col("event_id_debit_event_type_concat")).alias("_key"), "credit_loss_flag"
    ).distinct()
    flagged = left_join_spreading_nulls(noted, flags, [("id_category_concat", "_key")])
    # A case without category equals no transfer's category, so cases that have one are all that is needed.
    cases = investigation_with_category(
        investigations.select("id", F.col("event_id").alias("_event"), F.col("event_type").alias("_type")),
        bridge,
        event_balances,
        how="inner",
    ).withColumnsRenamed({"id": "_case", "transaction_category": "_category"})
    full = left_join_repeating(
        flagged,
        cases.distinct(),
        [("event_id", "_event"), ("event_type", "_type"), ("transaction_category", "_category")],
        null_keys="together",
    )
    return full.select(
        "bad_debt_id",
        "loss_identification_date",
        "effective_date",
        "transaction_category",
        "event_type",
        "company_name",
        "bad_debt_amount",
        "bad_debt_reason",
        "notes",
        "override_status",
        "payment_event_balance_id",
        "payment_event_balance_amount",
        "loss_event_fiscal_year",
        "written_off_fiscal_year",
        "event_date",
        text_id(F.col("event_id")).alias("inv_or_event_id"),
        "id_category_concat",
        text_id(F.col("company_id")).alias("company_id"),
        "bad_debt_approval_create_ts",
        writeoff_category(F.col("bad_debt_reason"), F.col("credit_loss_flag"), partner_reason, partner_label).alias(
            "updated_category"
        ),
        unpadded_month(F.col("effective_date")).alias("bd_write_off_month_year"),
        F.coalesce(F.col("_case").cast("string"), F.lit("No PI")).alias("payment_investigation_id"),
    ).distinct()


def bad_debt_loss_quarterly(transfers: DataFrame, debts: DataFrame, until: datetime.date) -> DataFrame:
    """Bad-debt transfers written off from the fiscal year floor on, with their notes."""
    notes = debts.select(F.col("bad_debt_id").alias("_debt"), "notes")
    return left_join_spreading_nulls(_written_off(transfers, until), notes, [("bad_debt_id", "_debt")]).select(
        "bad_debt_id",
        "loss_identification_date",
        F.col("loss_event_fiscal_year").alias("year_loss_event_occurred"),
        "effective_date",
        F.col("written_off_fiscal_year").alias("fiscal_year_written_off"),
        "transaction_category",
        "event_type",
        F.col("event_date").alias("event_day_or_formonth"),
        F.col("event_id").alias("inv_or_event_id"),
        normalize_key(F.col("event_id_transaction_category_concat")).alias("concat_id_category"),
        "company_id",
        F.col("company_name").alias("name"),
        "bad_debt_amount",
        F.col("bad_debt_reason").alias("reason"),
        "notes",
        F.col("bad_debt_approval_create_ts").cast("date").alias("bad_debt_approval_created_at"),
        "override_status",
        "approval_id",
        "payment_event_balance_id",
    )
