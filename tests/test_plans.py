"""Physical plans: what must not appear in them, and what must reach the scan."""

import re

import pytest

from checks import catalog
from checks.fixtures import Tables, store
from tallybook.plans import profile

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def unbroadcast(spark):
    """Plans as for tables too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    store(spark, DATA, "stored", str(tmp_path_factory.mktemp("stored")))
    return "stored"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(catalog.ALL))
def test_no_nested_loops_no_python_no_forced_broadcast(unbroadcast, key):
    plan = plan_of(catalog.queries()[key](unbroadcast, DATA))
    for operator in ("NestedLoop", "Cartesian", "BroadcastHashJoin", "Python", "Pandas"):
        assert operator not in plan, operator


def stored_plan(spark, stored, key) -> str:
    run, _ = catalog.ALL[key]
    return plan_of(run(Tables(spark, DATA, stored)))


@pytest.mark.parametrize("key", ["loss_exposure", "recovery_and_loss_180", "netting_analysis", "exclusion_population"])
def test_snapshot_dates_prune_partitions(spark, stored, key):
    plan = stored_plan(spark, stored, key)
    filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan)
    assert any("snapshot_date" in f for f in filters)


@pytest.mark.parametrize(
    "key,column",
    [
        ("paid_payroll_by_month", "check_date"),
        ("cash_bank_transactions", "bank_transaction_date"),
        ("breakdown_pnc", "bank_transaction_date"),
        ("negative_event_balances", "bank_transaction_date"),
        ("bank_balances_by_account", "transaction_date"),
        ("bank_statement_export", "date"),
    ],
)
def test_date_ranges_reach_the_scan(spark, stored, key, column):
    plan = stored_plan(spark, stored, key)
    pushed = " ".join(re.findall(r"PushedFilters: (.*?), ReadSchema", plan))
    assert f"LessThanOrEqual({column}" in pushed or f"LessThan({column}" in pushed


def test_columns_are_pruned(spark, stored):
    plan = stored_plan(spark, stored, "negative_event_balances")
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "on_behalf_of_name" not in schema and "investigation_status" not in schema


def test_netting_reads_the_ledger_once(spark, stored):
    plan = stored_plan(spark, stored, "netting_analysis")
    assert len(re.findall(r"FileScan parquet spark_catalog.stored.accounting_balance_history", plan)) == 1


def test_bucketed_tables_join_without_shuffle(unbroadcast, stored):
    from tallybook.operators.joins import left_join_repeating
    from tallybook.sources.tables import write_table

    tables = Tables(unbroadcast, DATA, stored)
    write_table(tables.payment_records, "stored.records_b", bucket_by=["id"], buckets=4)
    write_table(tables.payment_record_entries, "stored.entries_b", bucket_by=["payment_record_id"], buckets=4)
    records = unbroadcast.table("stored.records_b").select("id", "bank_account")
    entries = unbroadcast.table("stored.entries_b").select("payment_record_id", "amount")
    joined = left_join_repeating(records, entries, [("id", "payment_record_id")])
    assert "Exchange" not in plan_of(joined)


def scans_of(plan: str, table: str) -> list[str]:
    """Columns that each scan of a stored table reads."""
    return re.findall(rf"FileScan parquet spark_catalog\.stored\.{table}\[.*?ReadSchema: struct<(.*?)>", plan)


@pytest.fixture(scope="module")
def wide_plan(unbroadcast, stored):
    return lambda key: stored_plan(unbroadcast, stored, key)


def test_the_wide_left_of_an_outer_join_is_scanned_once(wide_plan):
    scans = scans_of(wide_plan("payment_entries"), "payment_records")
    assert sorted(s.count(":") for s in scans) == [2, 8]  # the second reads the key and the date only


def test_tuples_of_keys_are_resolved_in_three_shuffle_joins(wide_plan):
    plan = wide_plan("polymorphic_or_join")
    assert plan.count("SortMergeJoin") <= 3
    # All key columns are narrow here; the left's own column is read for the rows that move, once.
    assert plan.count("BroadcastHashJoin") == 0


def test_the_bank_side_of_a_match_is_planned_once(wide_plan):
    assert len(scans_of(wide_plan("match_classify"), "bank_transactions_raw")) == 1


def test_the_ledger_is_restricted_before_it_is_grouped(wide_plan):
    plan = wide_plan("recovery_receivable_fy23")
    depth = {m.group(2): len(m.group(1)) for m in re.finditer(r"^([\s:|+*\-\d()]*)(SortMergeJoin \[event_id.*LeftSemi|HashAggregate\(keys=\[event_id.*partial_sum)", plan, re.M)}
    aggregate = next(d for k, d in depth.items() if k.startswith("HashAggregate"))
    semi = next(d for k, d in depth.items() if k.startswith("SortMergeJoin"))
    assert semi > aggregate


def test_finished_events_are_counted_without_multiplying_rows(unbroadcast, stored):
    tables = Tables(unbroadcast, DATA, stored)
    plan = plan_of(profile.device_summary(tables.track_events, tables.payroll_admins, tables.companies))
    assert "Expand" not in plan and len(scans_of(plan, "track_events")) == 1
    # Events are grouped three times by their user before the admin's companies are joined.
    assert plan.count("SortMergeJoin") == 2 and "SortMergeJoin [_device_user" in plan


def test_charge_offs_plan_each_side_once_wide(wide_plan):
    plan = wide_plan("recovery_charge_offs")
    assert len(re.findall(r"(?<!Reused)Exchange ", plan)) <= 18
    wide = [s for s in scans_of(plan, "fct_bad_debt_transfer_history") if "company_name" in s]
    assert len(wide) == 1


def test_categories_of_investigations_are_joined_once(wide_plan):
    plan = wide_plan("investigation_with_category")
    assert len(scans_of(plan, "payment_event_balances")) == 1


@pytest.mark.parametrize("key", ["investigation_with_category", "recovery_charge_offs"])
def test_the_ledger_behind_derived_tables_is_grouped_once(unbroadcast, key):
    plan = plan_of(catalog.queries()[key](unbroadcast, DATA))
    assert "l_partkey" not in plan  # a column of the ledger's source
