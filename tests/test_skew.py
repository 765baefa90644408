"""One key with a third of all rows: the plan splits it, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from tallybook.operators import joins, matching

c = F.col
ROWS = 120_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skew_settings(spark):
    old = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def many(spark):
    """A third of the rows on key 7, a third on NULL."""
    key = F.when(c("id") % 3 == 0, F.lit(7)).when(c("id") % 3 == 1, F.lit(None)).otherwise(c("id") % 5000)
    return spark.range(0, ROWS, 1, 8).select(key.alias("k"), F.sha2(c("id").cast("string"), 256).alias("v"))


def few(spark):
    return spark.range(0, 6000, 1, 4).select(
        F.when(c("id") >= 0, c("id")).alias("rk"), F.sha2(c("id").cast("string"), 256).alias("w")
    )


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_key_on_the_right_of_a_left_join_is_split(skew_settings):
    df = joins.left_join_repeating(few(skew_settings), many(skew_settings), [("rk", "k")])
    assert "skew=true" in final_plan(df)
    known = many(skew_settings).filter(c("k").isNotNull())
    assert df.count() == known.count() + 6000 - known.select("k").distinct().count()


def test_hot_key_on_the_left_is_split_and_null_keys_are_spread(skew_settings):
    df = joins.left_join_spreading_nulls(many(skew_settings), few(skew_settings), [("k", "rk")])
    assert "skew=true" in final_plan(df)
    assert df.count() == ROWS
    slices = (
        many(skew_settings)
        .filter(c("k").isNull())
        .groupBy(F.pmod(F.xxhash64("k", "v"), F.lit(joins.NULL_KEY_SLICES)).alias("s"))
        .count()
    )
    assert slices.agg(F.max("count")).first()[0] < ROWS / 3 / 50


def test_hot_journal_id_is_split(skew_settings):
    bank = few(skew_settings).select(
        c("rk").alias("bank_transaction_id"), F.current_date().alias("date"), F.lit(3).alias("origination_account_id"),
        F.lit(1).cast("decimal(18,2)").alias("signed_amount"),
    )
    journal = many(skew_settings).select(
        F.lit(1).cast("decimal(18,2)").alias("amount"), c("v").alias("je_number"),
        c("k").cast("string").alias("bank_transaction_id"), F.lit("3").alias("origination_account_id"),
        F.lit("01/01/24").alias("bank_transaction_date"),
    )
    for df in (matching.matched(bank, journal), matching.match_classify(bank, journal)):
        assert "skew=true" in final_plan(df)


def test_keys_are_combined_before_a_counting_shuffle(skew_settings):
    keys = many(skew_settings).select(c("k").cast("string").alias("uid"))
    base = few(skew_settings).select(c("rk").cast("string").alias("uid"))
    df = matching.priority_match(base, [(keys, "held")], "free")
    hot = df.filter(c("uid") == "7").groupBy("match").count().collect()
    assert [(r.match, r["count"]) for r in hot] == [("held", keys.filter(c("uid") == "7").count())]
