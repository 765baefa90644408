"""Column rules on hand-made rows: NULLs, gaps, ties."""

import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallybook.functions import amounts, dates, keys, labels

c = F.col
DAY = datetime.date


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_sign_rules_differ_for_unknown_directions(spark):
    rows = [(0, D("5.00")), (1, D("5.00")), (7, D("5.00")), (None, D("5.00")), (0, None)]
    schema = "d int, a decimal(18,2)"

    def run(rule):
        return values(spark, schema, rows, rule(c("d"), c("a")))

    assert run(amounts.signed_amount) == [D("5.00"), D("-5.00"), D("0.00"), D("0.00"), None]
    assert run(amounts.signed_amount_else_negative) == [D("5.00"), D("-5.00"), D("-5.00"), D("-5.00"), None]
    assert run(amounts.signed_amount_else_null) == [D("5.00"), D("-5.00"), None, None, None]


def test_bank_signs_are_opposite(spark):
    rows = [(4, 12345), (2, 12345), (6, 12345), (None, 12345), (4, None)]
    schema = "t int, a long"
    dollars = values(spark, schema, rows, amounts.bank_signed_amount(c("t"), c("a")))
    assert dollars == [D("123.45"), D("-123.45"), D("0.00"), D("0.00"), None]
    cents = values(spark, schema, rows, amounts.bank_signed_cents(c("t"), c("a")))
    assert cents == [-12345, 12345, 0, 0, None]
    assert values(spark, schema, rows, amounts.bank_side(c("t"))) == ["CREDIT", "DEBIT", None, None, "CREDIT"]


def test_large_cents_keep_every_digit(spark):
    rows = [(4, 999_999_999_999_999_999)]
    assert values(spark, "t int, a long", rows, amounts.bank_signed_amount(c("t"), c("a"))) == [
        D("9999999999999999.99")
    ]


def test_paren_amounts(spark):
    rows = [("1,234.56",), ("(1,234.56)",), ("0.10",), ("(7)",), ("5.00 ",), (None,), ("",)]
    assert values(spark, "t string", rows, amounts.parse_paren_amount(c("t"))) == [
        D("1234.56"), D("-1234.56"), D("0.10"), D("-7.00"), D("5.00"), None, None,
    ]
    with pytest.raises(Exception, match="not an amount: 'n/a'"):
        values(spark, "t string", [("n/a",)], amounts.parse_paren_amount(c("t")))


def test_mixed_dates(spark):
    rows = [("03/05/2024",), ("03/05/24",), ("3/5/24",), ("45356",), ("",), (None,), ("03/05/2024 ",), ("45356.0",), (" ",)]
    assert values(spark, "t string", rows, dates.parse_mixed_date(c("t"))) == [
        DAY(2024, 3, 5), DAY(2024, 3, 5), DAY(2024, 3, 5), DAY(2024, 3, 5), None, None, DAY(2024, 3, 5), DAY(2024, 3, 5), None,
    ]


@pytest.mark.parametrize("text", ["13/45/24", "x", "03/05/024"])
def test_unreadable_dates_are_errors(spark, text):
    with pytest.raises(Exception, match=f"not a date: '{text}'"):
        values(spark, "t string", [(text,)], dates.parse_mixed_date(c("t")))


def test_strict_dates_take_two_digit_years_only(spark):
    rows = [("12/31/23",), ("12/31/2023",), ("45356",), ("",), ("01/02/71",)]
    assert values(spark, "t string", rows, dates.parse_date_or_null(c("t"))) == [
        DAY(2023, 12, 31), None, None, None, DAY(2071, 1, 2),
    ]


def test_keys_are_null_as_soon_as_a_part_is(spark):
    rows = [(1, "Net Pay"), (None, "Net Pay"), (1, None)]
    assert values(spark, "e long, t string", rows, keys.event_uid(c("e"), c("t"))) == ["1xNet Pay", None, None]
    assert values(spark, "e long, t string", rows, keys.text_id(c("e"))) == ["1x", None, "1x"]
    assert values(spark, "k string", [("1-A-B",), ("1xA",), (None,)], keys.normalize_key(c("k"))) == [
        "1xAxB", "1xA", None,
    ]


def test_aging_buckets_have_gaps_for_fractions(spark):
    rows = [(0.0,), (30.0,), (30.5,), (31.0,), (90.0,), (120.0,), (121.0,), (180.0,), (180.5,), (181.0,), (None,), (-4.0,)]
    assert values(spark, "a double", rows, labels.aging_bucket(c("a"))) == [
        "0 - 30 days", "0 - 30 days", None, "31 - 60 days", "61 - 90 days", "91 - 120 days", "121 - 180 days",
        "121 - 180 days", "> 180 days", "> 180 days", None, "0 - 30 days",
    ]


def test_loss_categories_differ_for_a_missing_category(spark):
    rows = [("Fraud", True), ("Fraud", None), ("Other", True), ("Other", False), ("Other", None), (None, True), (None, None)]
    schema = "c string, f boolean"
    assert values(spark, schema, rows, labels.loss_category(c("c"), c("f"))) == [
        "Fraud", "Fraud", "Credit", "Product", "Product", "Credit", "Product",
    ]
    assert values(spark, schema, rows, labels.loss_category_strict(c("c"), c("f"))) == [
        "Fraud", "Fraud", "Credit", "Product", "Product", "Product", "Product",
    ]


def test_writeoff_category(spark):
    rows = [("Fraud loss", True), ("ATO concession", None), ("Partner", True), ("Other", True), ("Other", False),
            ("Other", None), (None, True)]
    rule = labels.writeoff_category(c("r"), c("f"), "Partner", "Invoiced")
    assert values(spark, "r string, f boolean", rows, rule) == [
        "Fraud", "Fraud", "Invoiced", "Credit", "Product", "Product", "Product",
    ]


def test_accounting_status_order(spark):
    rows = [
        (D("0"), "false_positive", 1, 10), (D("-1"), "false_positive", 1, 100), (D("-1"), "awaiting_bad_debt_funds", 1, 100),
        (D("-1"), "open", 9, 100), (D("-1"), "open", 1, 90), (D("-1"), "open", 1, 89), (D("-1"), None, 1, None),
    ]
    rule = labels.accounting_status(c("b"), c("s"), c("i"), c("a"), [9])
    assert values(spark, "b decimal(18,2), s string, i long, a int", rows, rule) == [
        "RecoveryReceivable_SuccessfullyRecoveredAfterPeriodEnd",
        "NotRecovery_FalsePositive",
        "NotRecovery_writtenoff_pendingcorptransfer",
        "NotRecovery_FalsePositive",
        "RecoveryReceivable_>90d",
        "RecoveryReceivable_<90d",
        "RecoveryReceivable_<90d",
    ]


def test_reserve_flag_and_investigation_category(spark):
    assert values(spark, "a int", [(90,), (89,), (None,)], labels.reserve_flag(c("a"))) == ["y", "n", None]
    rows = [("expedited",), ("fraud",), ("x",), (None,)]
    assert values(spark, "x string", rows, labels.investigation_category(c("x"))) == ["Credit", "Fraud", "Other", "Other"]


def test_labels_with_and_without_fallback(spark):
    rows = [(1, "Bank", "ops"), (5, "Bank", "ops"), (5, None, "ops"), (None, "Bank", "ops")]
    schema = "i int, b string, p string"
    assert values(spark, schema, rows, labels.mapped_label(c("i"), {1: "One"})) == ["One", None, None, None]
    rule = labels.account_label_with_fallback(c("i"), c("b"), c("p"), {1: "One"})
    assert values(spark, schema, rows, rule) == ["One", "Bank ops", None, "Bank ops"]


def test_first_match_like_takes_the_first_rule(spark):
    rule = labels.first_match_like([(c("a"), "%tax%", "tax"), (c("b"), "%x%", "x")], "none")
    rows = [("tax", "x"), ("y", "x"), (None, "ax"), (None, None)]
    assert values(spark, "a string, b string", rows, rule) == ["tax", "x", "x", "none"]


def test_inclusion_flag_counts_unknown_as_excluded(spark):
    rule = labels.inclusion_flag(c("r"), c("t"), c("a"), c("d"), c("o"))
    day = DAY(2024, 1, 1)
    rows = [
        (True, "Net Pay", "Chase operations", day, True), (None, "Net Pay", "Chase operations", day, True),
        (True, "Invoices", "Chase operations", day, True), (True, None, "Chase operations", day, True),
        (True, "Net Pay", None, day, True), (True, "Net Pay", "PNC corporate", day, True),
        (True, "Net Pay", "Chase operations", None, True), (True, "Net Pay", "Chase operations", day, False),
        (True, "Net Pay", "Chase operations", day, None),
    ]
    got = values(spark, "r boolean, t string, a string, d date, o boolean", rows, rule)
    assert got == ["Should Include"] + ["Excluded"] * 8


def test_dates(spark):
    end = DAY(2024, 6, 30)
    rows = [(None,), (DAY(2024, 6, 30),), (DAY(2024, 7, 1),), (DAY(2024, 6, 29),)]
    assert values(spark, "d date", rows, dates.settlement_timing(c("d"), end)) == [
        "not_yet_settled", "settled_on_period_end_date", "settled_after_period_end_date", "settled_before_period_end_date",
    ]
    floored = values(spark, "d date", [(None,), (DAY(2019, 1, 1),), (DAY(2021, 1, 1),)], dates.date_floor(c("d"), DAY(2020, 1, 1)))
    assert floored == [None, DAY(2020, 1, 1), DAY(2021, 1, 1)]


def test_month_boundaries_and_calendar_days(spark):
    rows = [(datetime.datetime(2024, 1, 31, 23), datetime.datetime(2024, 2, 1, 1))]
    schema = "a timestamp, b timestamp"
    assert values(spark, schema, rows, dates.months_crossed(c("a"), c("b"))) == [1]
    assert values(spark, schema, rows, dates.age_in_days(c("a"), c("b"))) == [1]
    assert values(spark, schema, rows, dates.padded_month(c("a"))) == ["2024-01"]
    assert values(spark, schema, rows, dates.unpadded_month(c("a"))) == ["2024-1"]


def test_yn_flag(spark):
    assert values(spark, "f boolean", [(True,), (False,), (None,)], labels.yn_flag(c("f"))) == ["Y", "N", "N"]


@pytest.mark.parametrize("patterns,kept", [(("%corp%",), ["ops"]), ((), ["ops", "corp", None])])
def test_like_none(spark, patterns, kept):
    df = spark.createDataFrame([("ops",), ("corp",), (None,)], "a string")
    assert [r.a for r in df.filter(labels.like_none(c("a"), patterns)).collect()] == kept
