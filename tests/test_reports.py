"""Reports on hand-made rows: the cases the derived tables cannot show."""

import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from checks.fixtures import Tables
from tallybook.params import Period
from tallybook.plans import balances, movement, netting, reserve
from tests.tieout import tie_out

c = F.col
DAY = datetime.date
DATA = "/root/testdata/sf0.001"
LEDGER = "pr_on_behalf_of_id long, on_behalf_of_name string, event_id long, transaction_category string, bank_transaction_date date, balance decimal(18,2)"
SNAPSHOT = (
    "snapshot_date date, bank_transaction_date date, id_category_concat string, event_id long, company_id long, "
    "event_type string, transaction_category string, pi_id long, pi_status string, pi_category string, pi_age_in_days int, "
    "accounting_to_reserve string, accounting_status_mapping string, accounting_pi_category string, balance decimal(18,2), "
    "current_balance decimal(18,2)"
)
TRANSFERS = (
    "snapshot_date date, effective_date date, fiscal_year_written_off string, override_status string, company_id long, "
    "bad_debt_id long, bad_debt_amount decimal(18,2), payment_event_balance_amount decimal(18,2), id_category_concat string"
)
P0, P1, P2 = (Period(DAY(2024, m, 28), DAY(2024, m + 1, 3)) for m in (1, 2, 3))


def receivable(period, key, company=1, status="open", category="other", mapping="RecoveryReceivable_<90d", age=10,
               kind="Other", balance="-5", current="-5", pi_id=1):
    return (period.snapshot_date, period.end, key, 1, company, "Payroll", "A", pi_id, status, category, age, "n", mapping,
            kind, D(balance), D(current))


def transfer(period, key, company=1, amount="5", status="pending", year="FY25"):
    return (period.snapshot_date, period.end, year, status, company, 1, D(amount), D(amount), key)


def test_netting_reaches_every_label_and_fans_out(spark, rows):
    early, late = DAY(2024, 1, 5), DAY(2024, 2, 5)
    events = {1: "rr twice", 2: "bad debt", 3: "excluded", 4: "unchanged", 5: "changed", 6: "paid", 7: "known before"}
    ledger = [(1, "n", e, "A", early, D("-5")) for e in events]
    ledger += [(1, "n", 5, "A", late, D("-1")), (1, "n", 6, "A", late, D("5"))]
    snapshot = [
        receivable(P1, "1-A", pi_id=1), receivable(P1, "1-A", pi_id=2),
        receivable(P1, "3-A", status="false_positive", mapping="NotRecovery_FalsePositive"), receivable(P0, "7-A"),
    ]
    got = netting.netting_analysis(
        spark.createDataFrame(ledger, LEDGER),
        spark.createDataFrame(snapshot, SNAPSHOT),
        spark.createDataFrame([transfer(P1, "2-A"), transfer(P1, "4-A", status="rejected"), transfer(P1, "4-A", year="FY24")], TRANSFERS),
        netting.NettingMonth(P0.end, P0),
        netting.NettingMonth(P1.end, P1),
    )
    assert rows(got, "uid", "second_match") == [
        ("1xA", "Recovery Receivable"), ("1xA", "Recovery Receivable"), ("2xA", "Bad Debts"),
        ("3xA", "Unchanged- matched to Exclusion"), ("4xA", "Unchanged"), ("5xA", "Unidentified Loss"), ("6xA", "Paid Off"),
    ]


def test_netting_rows_are_the_unmatched_rows_of_month_1(spark):
    from checks.catalog import queries

    placed = queries()["netting_analysis"](spark, DATA)
    labelled = queries()["priority_match"](spark, DATA).filter(c("match") == "unmatched")
    assert tie_out(placed.select("uid", "balance").distinct(), labelled, ["uid"], "balance").isEmpty()


def test_matched_and_unmatched_add_up_to_the_full_join(spark):
    from checks.catalog import queries

    run = queries()
    full = run["match_classify"](spark, DATA).filter(c("scenario").isNotNull()).count()
    parts = sum(run[k](spark, DATA).count() for k in ("cash_matches", "cash_unmatched_bank", "cash_unmatched_journal"))
    assert full == parts > 0


def test_reserve_formulas(spark):
    balances_schema = "snapshot_date date, company_id long, balance decimal(18,2), effective_from_date date, effective_to_date date"

    def cash(company, *amounts):
        return [
            (p.snapshot_date, company, None if a is None else D(a), DAY(2024, 1, 1), DAY(2024, 12, 31))
            for p, a in zip((P0, P1, P2), amounts)
            if a != "absent"
        ]

    cash_rows = cash(1, "-100", "-100", "-100") + cash(2, "-90", "-100", "-100") + cash(3, "absent", "absent", "-40")
    cash_rows += cash(4, "0", "0", "0") + cash(5, "10", "10", "10")
    snapshot = [
        receivable(P2, "1-A", company=5, age=200, mapping="RecoveryReceivable_>90d", balance="-7", pi_id=1),
        receivable(P2, "2-A", company=5, age=20, kind="Fraud", balance="-3", pi_id=2),
        receivable(P2, "3-A", company=5, age=95, mapping="RecoveryReceivable_SuccessfullyRecoveredAfterPeriodEnd", balance="-2",
                   current="1", status="recovered", pi_id=3),
        receivable(P2, "4-A", company=5, age=95, kind=None, mapping="RecoveryReceivable_>90d", balance="-1", pi_id=4),
    ]
    got = reserve.recovery_and_loss_180(
        spark.createDataFrame(cash_rows, balances_schema),
        spark.createDataFrame([transfer(P2, "9-A", company=3, amount="15")], TRANSFERS),
        spark.createDataFrame(snapshot, SNAPSHOT),
        P0, P1, P2,
    )
    r = {row.company_id: row for row in got.collect()}
    assert set(r) == {"1x", "2x", "3x", "5x"}
    # Shortfall of 100 unchanged for both lags: reserved, and charged off after 180 days.
    assert (r["1x"].recovery_reserve_manual, r["1x"].recovery_reserve_manual_180_days) == (D("100.00"), D("-100.00"))
    assert r["1x"].liability_by_customer == D("0.00") and r["1x"].adjusted_cash == D("0.00")
    # Changed since the second lag: reserved, but not charged off.
    assert (r["2x"].recovery_reserve_manual, r["2x"].recovery_reserve_manual_180_days) == (D("100.00"), D("0.00"))
    # No earlier balance: nothing to compare with.
    assert (r["3x"].recovery_reserve_manual, r["3x"].recovery_manual) == (D("0.00"), D("25.00"))
    five = r["5x"]
    assert (five.recovery_identified, five.pis_older_than_180_days, five.fraud_pis, five.recovery_reserve_identified) == (
        D("13.00"), D("7.00"), D("3.00"), D("9.00"),
    )
    assert five.reserve_total == D("9") + D("3") - D("7")


RECORDS = (
    "id long, on_behalf_of_id long, bank_transaction_date date, bank_account string, origination_account_id int, "
    "reconciled boolean, transaction_type string, payment_category string, debit_amount decimal(18,2), "
    "credit_amount decimal(18,2), signed_amount decimal(18,2), bank_transaction_ids string"
)


def test_movement_branches_overlap(spark, rows):
    day = DAY(2024, 1, 5)

    def record(i, owner, account, kind="Payroll", category="Net Pay", signed="5", ids="1"):
        return (i, owner, day, account, 16, True, kind, category, D("5"), None, D(signed), ids)

    df = spark.createDataFrame(
        [
            record(1, 1, "Chase operations"), record(2, 1, "PNC operations"), record(3, 7, "PNC operations"),
            record(4, 7, "PNC operations", kind="Debit balance transfer", signed="20000000"),
            record(5, 7, "PNC operations", kind="Debit balance transfer", signed="20000000.01"),
            record(6, 7, "PNC operations", category="Others", ids="77"), record(7, None, "PNC operations"),
            record(8, 1, "PNC corporate"), record(9, 1, None),
        ],
        RECORDS,
    )
    got = movement.monthly_movement_by_category(df, day, day, 7, "PNC operations", mitigation_bank_ids=[77])
    assert rows(got, "bank_account", "transaction_type", "payment_category", "reconciled_payment_records") == [
        ("Chase operations", "Payroll", "Net Pay", D("5.00")),
        ("PNC operations", "Debit balance transfer", "Net Pay", D("20000000.00")),
        ("PNC operations", "Debit balance transfer", "Net Pay", D("40000000.01")),
        ("PNC operations", "Payroll", "Net Pay", D("5.00")),
        ("PNC operations", "Payroll", "Net Pay", D("5.00")),
        ("PNC operations", "Payroll", "Others", D("5.00")),
        ("PNC operations", "Payroll", "Others", D("5.00")),
    ]


def test_aging_finds_the_first_dip_within_a_day(spark, rows):
    ledger = spark.createDataFrame(
        [
            (1, "n", 1, "A", DAY(2024, 1, 1), D("5")), (1, "n", 1, "A", DAY(2024, 1, 2), D("-6")),
            (2, "n", 1, "A", DAY(2024, 1, 2), D("9")), (1, "n", 2, "A", DAY(2024, 1, 1), D("-1")),
            (1, "n", None, "A", DAY(2024, 1, 1), D("-1")), (1, "n", 3, "A", DAY(2024, 1, 1), D("0")),
        ],
        LEDGER,
    )
    got = balances.aging_first_negative(ledger, DAY(2024, 6, 1), ["1xA", "3xA", "9xA"])
    assert rows(got) == [("1xA", DAY(2024, 1, 2), D("-1.00"))]


def test_owner_total_is_the_sum_of_the_owners(spark):
    ledger = Tables(spark, DATA).accounting_balance_history
    day = DAY(2023, 6, 30)
    for negative in (True, False):
        owners = balances.accounting_balance_aggregates(ledger, day, negative)
        total = balances.accounting_balance_total(ledger, day, negative).first().balance
        assert owners.agg(F.sum("balance")).first()[0] == total


def test_tie_out_shows_only_differences(spark, rows):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("z", 0)], "k string, v int")
    assert len(rows(tie_out(a, b, ["k"], "v"))) == 3
    assert tie_out(a, a, ["k"], "v").isEmpty()


@pytest.mark.parametrize("excluded,expected", [((), 1), ((7,), 0)])
def test_transfer_of_an_excluded_owner(spark, excluded, expected):
    records = spark.createDataFrame(
        [(1, 7, DAY(2024, 1, 30), DAY(2024, 1, 31), "Chase operations", 3, "NachaEntry", D("-5"), D("5"), True)],
        "id long, on_behalf_of_id long, date date, bank_transaction_date date, bank_account string, origination_account_id int, "
        "transmission_type string, signed_amount decimal(18,2), payment_record_entries_sum decimal(18,2), reconciled boolean",
    )
    moved = spark.createDataFrame(
        [(1, 9, "Transfer", "Internal Transfer")],
        "payment_record_id long, event_id long, event_type string, transaction_category string",
    )
    companies = spark.createDataFrame([(7, "Seven")], "id long, name string")
    got = movement.deposits_in_transit(records, moved, companies, DAY(2024, 1, 31), excluded)
    assert got.count() == expected
    if expected:
        row = got.first()
        assert (row.settlement_timing, row.event_balance, row.on_behalf_of_name) == ("not_yet_settled", D("-5.00"), "Seven")
