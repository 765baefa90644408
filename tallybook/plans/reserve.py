"""Customer liability and reserve with the 180-day charge-off."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook import constants as K
from tallybook.functions.amounts import TOTAL, zero_if_null
from tallybook.functions.keys import text_id
from tallybook.functions.labels import aging_bucket
from tallybook.operators.asof import effective_between, snapshot_as_of
from tallybook.operators.filters import any_nonzero_filter
from tallybook.operators.populations import in_period, recovery_rows
from tallybook.params import Period

RECEIVABLE_KEY_COLUMNS = (
    "snapshot_date", "bank_transaction_date", "id_category_concat", "event_id", "company_id", "event_type",
    "transaction_category", "pi_id", "pi_status", "pi_category", "pi_age_in_days", "accounting_to_reserve",
    "accounting_status_mapping", "accounting_pi_category", "balance", "current_balance",
)

NONZERO_MEASURES = (
    "balance", "loss_due_to_transfer", "pis_older_than_180_days", "recovery_identified",
    "pis_older_than_180_days_negative", "recovery_reserve_identified", "fraud_pis",
    "pis_older_than_180_days_accounting_charge_off", "recovery_reserve_manual", "recovery_reserve_manual_180_days",
    "cash_before_accounting_charge_off", "recovery_reserve_manual_180_days_negative", "recovery_manual",
)


def _losses(transfers: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Pending bad debt per company, one column per period, in one pass."""

    def effective(period: Period) -> Column:
        return (F.col("snapshot_date") == F.lit(period.snapshot_date)) & (
            F.col("effective_date") <= F.lit(period.end)
        )

    pending = transfers.filter(
        F.col("snapshot_date").isin([p.snapshot_date for p in periods])
        & (F.col("override_status") == K.BAD_DEBT_OPEN_STATUS)
        & (F.col("fiscal_year_written_off") >= K.FISCAL_YEAR_FLOOR)
    )
    return pending.groupBy(F.col("company_id").alias("loss_company")).agg(
        *[
            F.sum(F.when(effective(p), F.col("bad_debt_amount"))).cast(TOTAL).alias(f"loss_{n}")
            for n, p in enumerate(periods)
        ]
    )


def _receivables(
    snapshot: DataFrame,
    periods: Sequence[Period],
    excluded_companies: Sequence[int],
    excluded_investigations: Sequence[int],
) -> DataFrame:
    """Receivable measures per company, one set of columns per period, in one pass."""
    rows = (
        recovery_rows(
            snapshot, [(p.end, p.snapshot_date) for p in periods], excluded_companies, excluded_investigations
        )
        .select(*RECEIVABLE_KEY_COLUMNS)
        .distinct()
    )
    amount = zero_if_null(F.col("balance"))
    mapping = F.col("accounting_status_mapping")
    reserved = (mapping == K.MAPPING_OVER_90) | (
        (mapping == K.MAPPING_RECOVERED) & (F.col("pi_age_in_days") >= K.RESERVE_AGE_DAYS)
    )
    measures = []
    for n, period in enumerate(periods):
        here = in_period(period.end, period.snapshot_date)

        def total(condition: Column = F.lit(True)) -> Column:
            return F.sum(F.when(here & condition, amount)).cast(TOTAL)

        measures += [
            F.abs(total()).alias(f"identified_{n}"),
            F.abs(total(aging_bucket(F.col("pi_age_in_days")) == K.BUCKET_OVER_180)).alias(f"p180_{n}"),
            F.abs(total(F.col("accounting_pi_category") == "Fraud")).alias(f"fraud_{n}"),
            total(reserved & (F.col("accounting_pi_category") != "Fraud")).alias(f"reserve_{n}"),
        ]
    return rows.groupBy(F.col("company_id").alias("receivable_company")).agg(*measures)


def recovery_and_loss_180(
    balances: DataFrame,
    transfers: DataFrame,
    snapshot: DataFrame,
    lag_2: Period,
    lag_1: Period,
    current: Period,
    excluded_companies: Sequence[int] = (),
    excluded_investigations: Sequence[int] = (),
) -> DataFrame:
    """Liability and reserve per company from three periods.

    Losses and receivables of all periods are pivoted into columns in one pass each, so
    every input meets the company's balances once, on ``company_id``.
    """
    periods = [lag_2, lag_1, current]

    def cash(n: int) -> DataFrame:
        rows = effective_between(snapshot_as_of(balances, periods[n].snapshot_date), periods[n].end)
        return rows.select(F.col("company_id").alias(f"company_{n}"), F.col("balance").alias(f"balance_{n}"))

    company = F.col("company_2")
    joined = (
        cash(2)
        .join(cash(1), company == F.col("company_1"), "left")
        .join(cash(0), company == F.col("company_0"), "left")
        .join(_losses(transfers, periods), company == F.col("loss_company"), "left")
        .join(
            _receivables(snapshot, periods, excluded_companies, excluded_investigations),
            company == F.col("receivable_company"),
            "left",
        )
    )

    def known(name: str) -> Column:
        return zero_if_null(F.col(name)).cast(TOTAL)

    def shortfall(amount: Column) -> Column:
        return F.when(amount < 0, -amount).otherwise(F.lit(0)).cast(TOTAL)

    def manual(n: int) -> Column:
        """Shortfall of a period; zero for a company without balance in that period."""
        return zero_if_null(
            shortfall(F.col(f"balance_{n}") + known(f"loss_{n}") + known(f"p180_{n}") + known(f"identified_{n}"))
        ).cast(TOTAL)

    steps = joined.select(
        text_id(company).alias("company_id"),
        F.col("balance_2").cast(TOTAL).alias("balance"),
        known("loss_2").alias("loss_due_to_transfer"),
        known("p180_2").alias("pis_older_than_180_days"),
        known("identified_2").alias("recovery_identified"),
        (-known("p180_2")).alias("pis_older_than_180_days_negative"),
        F.abs(known("reserve_2")).alias("recovery_reserve_identified"),
        known("fraud_2").alias("fraud_pis"),
        (-known("p180_2")).alias("pis_older_than_180_days_accounting_charge_off"),
        *[manual(n).alias(f"manual_{n}") for n in range(3)],
    )
    now = F.col("manual_2")

    def kept(n: int) -> Column:
        return F.when((now != 0) & (F.col(f"manual_{n}") == now), now).otherwise(F.lit(0)).cast(TOTAL)

    def column(name: str, value: Column):
        nonlocal steps
        steps = steps.withColumn(name, value.cast(TOTAL))

    c = F.col
    column("recovery_reserve_manual", kept(1))
    column("recovery_reserve_manual_180_days", -kept(0))
    column("recovery_reserve_manual_180_days_negative", -c("recovery_reserve_manual_180_days"))
    column("cash_before_accounting_charge_off", c("balance") + c("loss_due_to_transfer"))
    column("recovery_manual", shortfall(c("cash_before_accounting_charge_off") + c("recovery_identified")))
    steps = any_nonzero_filter(steps, NONZERO_MEASURES)
    column(
        "adjusted_cash",
        c("cash_before_accounting_charge_off")
        + c("pis_older_than_180_days")
        + c("recovery_reserve_manual_180_days_negative"),
    )
    column(
        "recovery_total",
        c("recovery_identified")
        + c("recovery_manual")
        + c("pis_older_than_180_days_negative")
        + c("recovery_reserve_manual_180_days"),
    )
    column(
        "reserve_total",
        c("recovery_reserve_identified")
        + c("fraud_pis")
        + c("pis_older_than_180_days_accounting_charge_off")
        + c("recovery_reserve_manual")
        + c("recovery_reserve_manual_180_days"),
    )
    column("liability_by_customer", c("adjusted_cash") + c("recovery_total"))
    return steps.select(
        "company_id",
        "balance",
        "loss_due_to_transfer",
        "cash_before_accounting_charge_off",
        "pis_older_than_180_days",
        "recovery_reserve_manual_180_days_negative",
        "adjusted_cash",
        "recovery_identified",
        "recovery_manual",
        "pis_older_than_180_days_negative",
        "recovery_reserve_manual_180_days",
        "recovery_total",
        "recovery_reserve_identified",
        "fraud_pis",
        "pis_older_than_180_days_accounting_charge_off",
        "recovery_reserve_manual",
        c("recovery_reserve_manual_180_days").alias("recovery_reserve_manual_180_days_for_reserve"),
        "reserve_total",
        "liability_by_customer",
    )
