"""Table operators on hand-made rows: NULL keys, duplicates, fan-out, hot keys."""

import datetime
import itertools
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybook.operators import asof, entries, filters, joins, matching, populations
from tallybook.operators.running import in_ranges, running_balance

c = F.col
DAY = datetime.date


def test_left_join_keeps_null_keys_once(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "rk long, w string")
    got = joins.left_join_spreading_nulls(left, right, [("k", "rk")])
    want = left.join(right, c("k") == c("rk"), "left")
    assert rows(got) == rows(want)


def test_spread_join_keeps_its_slice_as_a_join_key(spark):
    left = spark.createDataFrame([(1, 1), (None, 2)], "k long, v long")
    right = spark.createDataFrame([(1,)], "rk long")
    df = joins.left_join_spreading_nulls(left, right, [("k", "rk")])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "_right_slice" in plan


def test_repeating_left_join_equals_plain_left_join(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, None), (None, "z")], "rk long, w string")
    got = joins.left_join_repeating(left, right, [("k", "rk")])
    assert rows(got) == rows(left.join(right, c("k") == c("rk"), "left"))


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 250_001)], "v string, n long")
    got = {r.v: r["count"] for r in joins.repeat_rows(df, "n").groupBy("v").count().collect()}
    assert got == {"a": 1, "b": 3, "c": 250_001}


PAIRS = [("a", "A"), ("b", "B"), ("d", "C")]


def _or_condition():
    condition = F.lit(False)
    for key, record_type in PAIRS:
        condition = condition | ((c("record_id") == c(key)) & (c("record_type") == record_type))
    return condition


@pytest.mark.parametrize("how", ["left", "inner"])
def test_polymorphic_join_equals_the_or_join(spark, rows, how):
    choices = [None, 1, 2, 3]
    left = spark.createDataFrame(
        [(n, *keys) for n, keys in enumerate(itertools.product(choices, repeat=3))], "n int, a long, b long, d long"
    )
    records = spark.createDataFrame(
        [(1, "A", 10), (1, "A", 11), (2, "B", 20), (3, "C", 30), (1, "C", None), (3, "X", 40), (None, "A", 50), (2, None, 60)],
        "record_id long, record_type string, tx long",
    )
    got = joins.polymorphic_join(left, records, PAIRS, how)
    want = left.join(records, _or_condition(), how).select("n", "a", "b", "d", "tx")
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_polymorphic_join_rejects_a_repeated_type(spark):
    df = spark.createDataFrame([(1, 1)], "a long, b long")
    records = spark.createDataFrame([(1, "A")], "record_id long, record_type string")
    with pytest.raises(ValueError):
        joins.polymorphic_join(df, records, [("a", "A"), ("b", "A")])


@pytest.mark.parametrize("listed", [[], [1], [1, 2], [1, None], [None]])
def test_not_in_subquery_equals_sql(spark, rows, listed):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k long, v string")
    sub = spark.createDataFrame([(v,) for v in listed], "k long")
    df.createOrReplaceTempView("probe")
    sub.createOrReplaceTempView("listed")
    want = spark.sql("SELECT * FROM probe WHERE k NOT IN (SELECT k FROM listed)")
    assert rows(filters.not_in_subquery(df, "k", sub)) == rows(want)


def test_id_list_filter_takes_lists_and_tables(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
    want = [(2, "b"), (2, "c")]
    assert rows(filters.id_list_filter(df, "k", [2, 9])) == want
    assert rows(filters.id_list_filter(df, "k", spark.createDataFrame([(2,), (2,), (None,)], "x long"))) == want
    for more in (10, 20_000):
        ids = [None, "2", "2", *map(str, range(100, 100 + more))]
        assert rows(filters.id_list_filter(df, "k", ids)) == want
        assert rows(filters.id_list_filter(df, "k", spark.createDataFrame([(i,) for i in ids], "x string"))) == want
    assert rows(filters.id_list_filter(df, "k", [])) == []


def test_any_nonzero_drops_all_null_rows(spark, rows):
    df = spark.createDataFrame([(1, 0, 0), (2, None, 3), (3, None, None), (4, None, 0)], "i int, a int, b int")
    assert rows(filters.any_nonzero_filter(df, ["a", "b"]), "i") == [(2,)]


def test_point_in_time_reads(spark, rows):
    df = spark.createDataFrame(
        [(1, DAY(2024, 1, 1), DAY(2024, 2, 1)), (2, DAY(2024, 2, 1), DAY(2024, 3, 1)), (3, DAY(2024, 3, 1), DAY(9999, 1, 1))],
        "i int, history_effective_from_ts date, history_effective_to_ts date",
    )
    assert rows(asof.scd2_as_of(df, DAY(2024, 2, 1)), "i") == [(2,)]
    assert rows(asof.scd2_as_of_after_go_live(df, DAY(2024, 2, 1), DAY(2024, 6, 1)), "i") == [(1,), (2,)]
    assert rows(asof.scd2_as_of_after_go_live(df, DAY(2024, 2, 1), DAY(2024, 1, 1)), "i") == [(2,)]
    closed = df.toDF("i", "effective_from_date", "effective_to_date")
    assert rows(asof.effective_between(closed, DAY(2024, 2, 1)), "i") == [(1,), (2,)]


SNAPSHOT = (
    "snapshot_date date, bank_transaction_date date, id_category_concat string, company_id long, pi_id long, "
    "pi_status string, pi_category string, accounting_status_mapping string, balance decimal(18,2), "
    "current_balance decimal(18,2)"
)
END, SNAP = DAY(2024, 3, 31), DAY(2024, 4, 5)


def test_recovery_population_over_all_combinations(spark):
    """Against the rule spelled out in Python with SQL's three-valued logic."""
    statuses = [None, "recovered", "open"]
    categories = [None, "micro variance", "fraud"]
    balances = [None, D("-1"), D("0"), D("1")]
    mappings = [None, "RecoveryReceivable_>90d", "NotRecovery_FalsePositive"]
    companies, cases = [None, 1, 2], [None, 5, 9]
    data, want = [], set()
    combos = itertools.product(statuses, categories, balances, mappings, companies, cases)
    for n, (status, category, balance, mapping, company, case) in enumerate(combos):
        data.append((SNAP, END, str(n), company, case, status, category, mapping, D("-5"), balance))
        keep = (
            status is not None and company == 1 and case == 5 and mapping == "RecoveryReceivable_>90d"
            and category != "micro variance" and (status != "recovered" or (balance is not None and balance >= 0))
        )
        if keep:
            want.add(str(n))
    df = spark.createDataFrame(data, SNAPSHOT)
    got = populations.recovery_population(df.union(df), END, SNAP, [2], [9]).collect()
    assert len(got) == len(want)
    assert {r.id_category_concat for r in got} == want
    assert populations.recovery_population(df, END, DAY(2024, 4, 6), [2], [9]).isEmpty()


def test_exclusion_population(spark, rows):
    base = (SNAP, END)
    data = [
        (*base, "1-A", 1, 1, "recovered", "micro variance", "m", D("-1"), None),
        (*base, "1-A", 1, 2, "false_positive", None, "m", D("-2"), None),
        (*base, "2-A", 1, 3, "open", "micro variance", "m", D("-4"), None),
        (*base, "3-A", 1, 4, "open", "fraud", "m", D("-8"), None),
        (*base, "4-A", 1, 5, None, "micro variance", "m", D("-16"), None),
    ]
    got = populations.exclusion_population(spark.createDataFrame(data, SNAPSHOT), END, SNAP)
    assert rows(got, "uid", "balance") == [("1xA", D("-3.00")), ("2xA", D("-4.00"))]


def test_negative_balances_judge_owners_one_by_one(spark, rows):
    data = [
        (1, 7, "A", DAY(2024, 1, 1), D("-5")), (2, 7, "A", DAY(2024, 1, 1), D("4")),
        (1, 8, "A", DAY(2024, 1, 1), D("-5")), (1, 8, "A", DAY(2024, 2, 1), D("9")),
        (1, 9, "A", DAY(2024, 1, 1), D("-0.01")), (1, None, "A", DAY(2024, 1, 1), D("-5")),
        (1, 6, "A", DAY(2024, 2, 1), D("-3")),
    ]
    ledger = spark.createDataFrame(
        data, "pr_on_behalf_of_id long, event_id long, transaction_category string, bank_transaction_date date, balance decimal(18,2)"
    )
    got = populations.negative_event_balances(ledger, DAY(2024, 1, 31), DAY(2024, 2, 28))
    assert rows(got) == [("6xA", None, D("-3.00")), ("7xA", D("-5.00"), D("-5.00")), ("8xA", D("-5.00"), None)]


BANK = "bank_transaction_id long, date date, origination_account_id int, signed_amount decimal(18,2)"
JOURNAL = "amount decimal(18,2), je_number string, bank_transaction_id string, origination_account_id string, bank_transaction_date string"


def test_match_scenarios_with_nulls_and_duplicates(spark):
    day = DAY(2024, 1, 1)
    bank = spark.createDataFrame([(1, day, 3, D("5")), (2, day, 3, D("6")), (None, day, 3, D("7"))], BANK)
    journal = spark.createDataFrame(
        [(D("5"), "J1", "1", "3", "01/01/24"), (D("5"), "J2", "1", "3", "01/01/24"), (D("8"), "J3", "9", "3", "01/01/24"),
         (D("9"), "J4", None, "3", "01/01/24")],
        JOURNAL,
    )
    full = matching.match_classify(bank, journal)
    found = sorted((r.scenario or "-", r.je_number or "-") for r in full.collect())
    assert found == [
        ("-", "-"), ("-", "J4"), ("Matched", "J1"), ("Matched", "J2"), ("Unmatched BT", "-"), ("Unmatched JE", "J3"),
    ]
    parts = [matching.matched(bank, journal), matching.unmatched_journal(bank, journal), matching.unmatched_bank(bank, journal)]
    assert [p.filter(c("scenario").isNotNull()).count() for p in parts] == [2, 1, 1]
    assert matching.matched(bank, journal).columns == full.columns


def test_priority_match_fans_out_on_duplicate_keys(spark, rows):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "uid string, v int")
    first = spark.createDataFrame([("a",), ("a",), (None,)], "uid string")
    second = spark.createDataFrame([("a",), ("b",), ("b",), ("b",)], "uid string")
    got = matching.priority_match(base, [(first, "one"), (second, "two")], "none")
    assert rows(got) == [("a", 1, "one", 1)] * 2 + [("b", 2, "two", 2)] * 3 + [("d", 3, "none", 3)]


@pytest.mark.parametrize("ranges", [None, 1, 7, 60])
def test_running_balance_of_a_hot_key_equals_one_long_window(spark, rows, ranges):
    data = spark.range(3000).select(
        F.when(c("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (c("id") % 50).cast("string"))).alias("uid"),
        F.when(c("id") % 97 == 0, F.lit(None)).otherwise(c("id") % 700).alias("pr_on_behalf_of_id"),
        F.date_add(F.lit(DAY(2024, 1, 1)), (c("id") % 5).cast("int")).alias("bank_transaction_date"),
        ((c("id") * 7919) % 2001 - 1000).cast("decimal(18,2)").alias("balance"),
    )
    daily = data.groupBy("uid", "pr_on_behalf_of_id", "bank_transaction_date").agg(F.sum("balance").alias("balance"))
    order = Window.partitionBy("uid").orderBy("bank_transaction_date", "pr_on_behalf_of_id")
    want = daily.withColumn("running_balance", F.sum("balance").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    columns = ["uid", "bank_transaction_date", "pr_on_behalf_of_id", "running_balance"]
    assert rows(running_balance(daily, ranges).withColumn("running_balance", c("running_balance").cast("decimal(38,2)")), *columns) == rows(
        want.withColumn("running_balance", c("running_balance").cast("decimal(38,2)")), *columns
    )


def test_running_balance_takes_equal_dates_by_owner(spark):
    daily = spark.createDataFrame(
        [("e", 1, DAY(2024, 1, 1), 100), ("e", 64, DAY(2024, 1, 1), -50)],
        "uid string, pr_on_behalf_of_id long, bank_transaction_date date, balance long",
    ).withColumn("balance", c("balance").cast("decimal(18,2)"))
    got = running_balance(daily, 2).orderBy("pr_on_behalf_of_id").collect()
    assert [int(r.running_balance) for r in got] == [100, 50]


def test_bunched_owners_of_one_day_fill_many_ranges(spark):
    """Nearly all ids lie close together: ranges of equal width would put them into one."""
    daily = spark.range(4000).select(
        F.lit("hot").alias("uid"), F.when(c("id") < 10, c("id") * 10**12).otherwise(c("id") + 10**6).alias("pr_on_behalf_of_id"),
        F.lit(DAY(2024, 1, 1)).alias("bank_transaction_date"), F.lit(1).cast("decimal(18,2)").alias("balance"),
    )
    sizes = [r["count"] for r in in_ranges(daily, 8).groupBy("part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1200
    assert running_balance(daily, 8).agg(F.max("running_balance"), F.countDistinct("running_balance")).first() == (4000, 4000)


def test_credit_loss_lookup_fans_out_on_different_flags_only(spark, rows):
    rr = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    credit = spark.createDataFrame([("a", True), ("a", True), ("a", None), ("x", False)], "ck string, is_credit_loss boolean")
    got = joins.credit_loss_lookup(rr, credit, c("k"), c("ck"))
    assert rows(got) == sorted([("a", 1, True), ("a", 1, None), ("b", 2, None), (None, 3, None)], key=repr)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_investigations_with_category(spark, rows, how):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    bridge = spark.createDataFrame([(1, 10), (1, 11), (2, None), (3, 99)], "payment_investigation_id long, payment_event_balance_id long")
    names = spark.createDataFrame([(10, "A"), (11, "B")], "id long, transaction_category string")
    got = rows(joins.investigation_with_category(cases, bridge, names, how))
    assert got == ([(1, "A"), (1, "B"), (2, None), (3, None)] if how == "left" else [(1, "A"), (1, "B")])


def test_reconciled_transactions_come_once(spark, rows):
    e = spark.createDataFrame([(1,), (1,), (2,)], "payment_record_id long")
    record_groups = spark.createDataFrame([(1, 100), (1, 101), (2, 100), (3, 103)], "payment_record_id long, reconciliation_group_id long")
    groups = spark.createDataFrame([(100, "active"), (101, "inactive"), (103, "active")], "id long, state string")
    bank_groups = spark.createDataFrame([(7, 100), (8, 101), (9, 103), (7, 101)], "bank_transaction_id long, reconciliation_group_id long")
    bank = spark.createDataFrame(
        [(7, DAY(2024, 1, 1), 3, 4, 150), (8, DAY(2024, 1, 1), 3, 2, 150), (9, DAY(2024, 1, 1), 3, 2, 150)],
        "id long, date date, origination_account_id int, transaction_type int, amount long",
    )
    got = entries.reconciled_bank_transactions(e, record_groups, groups, bank_groups, bank)
    assert rows(got) == [(7, DAY(2024, 1, 1), 3, D("1.50"))]
