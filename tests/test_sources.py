"""CSV ingestion and sinks."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.params import DateRange, period_params
from tallybook.session import scratch_folder
from tallybook.sources import csv_ingest as ingest
from tallybook.sources.tables import table_scan, write_csv, write_jdbc

TEXT = '''id,gaps,price,flag,flag gaps,when,name,blank,huge
1,1,1.5,True,True,2024-01-31,"O""Neil, A",,99999999999999999999
2,,2,False,,2024-02-01,plain,NA,1
3,3,-3e2,true,False,2024-02-02,"x'y",,2
'''


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "data.csv").write_text(TEXT)
    return tmp_path


def test_types_follow_all_of_the_data(spark, folder):
    df = ingest.csv_ingest(spark, str(folder), "data.csv", "ingested")
    kinds = {f.name: type(f.dataType) for f in df.schema}
    assert kinds == {
        "id": T.LongType, "gaps": T.DoubleType, "price": T.DoubleType, "flag": T.BooleanType, "flag gaps": T.StringType,
        "when": T.StringType, "name": T.StringType, "blank": T.DoubleType, "huge": T.StringType,
    }
    got = {r.id: r for r in df.collect()}
    assert [got[i].gaps for i in (1, 2, 3)] == [1.0, None, 3.0]
    assert got[3].price == -300.0 and got[3].flag is True
    assert got[1].name == 'O"Neil, A' and got[3].name == "x'y"
    assert got[1].huge == "99999999999999999999"


def test_load_replaces_the_table(spark, folder):
    ingest.csv_ingest(spark, str(folder), "data.csv", "replaced")
    (folder / "deep" / "er" / "data.csv").write_text("a\n1\n")
    df = ingest.csv_ingest(spark, str(folder), "data.csv", "replaced")
    assert df.columns == ["a"] and df.count() == 1


def test_missing_file_raises_and_keeps_the_table(spark, folder):
    ingest.csv_ingest(spark, str(folder), "data.csv", "kept")
    with pytest.raises(FileNotFoundError):
        ingest.csv_ingest(spark, str(folder), "none.csv", "kept")
    assert spark.table("kept").count() == 3


def test_the_file_nearest_to_the_root_is_taken(spark, folder):
    (folder / "data.csv").write_text("top\n1\n")
    assert ingest.find_csv(spark, str(folder), "data.csv").endswith(f"{folder}/data.csv")


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"two\nlines"\n2,"plain"\n')
    df = ingest.read_typed_csv(spark, str(tmp_path / "m.csv"))
    assert sorted((r.a, r.b) for r in df.collect()) == [(1, "two\nlines"), (2, "plain")]


def many_breaks(n: int) -> list[tuple[int, str, str]]:
    texts = ["plain", "two\nlines", 'say ""x""', "a,b", "\n\n", "end\n", "long " * 400 + "\n" * 50]
    return [(i, texts[i % 7] if i % 3 else texts[0], f"z{i}") for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in old:
        spark.conf.set(key, "1000")
    yield spark
    for key, value in old.items():
        spark.conf.set(key, value)


def test_records_that_cross_blocks(small_blocks, tmp_path):
    rows = many_breaks(400)
    text = "".join(f'{i},"{t}",{z}\n' for i, t, z in rows)
    (tmp_path / "m.csv").write_text('number,"a\nname",_surplus\n' + text)
    lines = ingest._lines(small_blocks, str(tmp_path / "m.csv"))
    lines.write.parquet(str(tmp_path / "lines"))
    lines = small_blocks.read.parquet(str(tmp_path / "lines"))
    assert lines.select("block").distinct().count() > 30
    assert ingest.split_records(lines).count() == 400
    df = ingest.read_typed_csv(small_blocks, str(tmp_path / "m.csv"))
    assert df.columns == ["number", "a\nname", "_surplus"]
    assert sorted(tuple(r) for r in df.collect()) == [(i, t.replace('""', '"'), z) for i, t, z in rows]


def test_a_folder_of_files_with_line_breaks(small_blocks, tmp_path):
    for n in range(3):
        text = "".join(f'{n * 100 + i},"{t}",{z}\r\n' for i, t, z in many_breaks(40))
        (tmp_path / f"part-{n}.csv").write_bytes(("number,t,z\r\n" + text + "\r\n").encode())
    df = ingest.read_typed_csv(small_blocks, str(tmp_path))
    want = [(n * 100 + i, t.replace('""', '"'), z) for n in range(3) for i, t, z in many_breaks(40)]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_one_line_break_leaves_many_tasks(small_blocks, tmp_path):
    text = "".join(f'{i},"{"x" * 50}"\n' for i in range(2000)) + '2000,"a\nb"\n'
    (tmp_path / "m.csv").write_text("i,t\n" + text)
    small_blocks.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = ingest.read_typed_csv(small_blocks, str(tmp_path / "m.csv"))
    small_blocks.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    used = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in used) == 2001 and len(used) >= 4 and max(r["count"] for r in used) < 1200


def test_quotes_in_plain_values(spark, tmp_path):
    for n, first in enumerate(['5" pipe,"x\ny"', '5" pipe,6" pipe', '5" pipe,6']):
        (tmp_path / f"m{n}.csv").write_text(f'a,b\n{first}\n2,"z"\n')
        df = ingest.read_typed_csv(spark, str(tmp_path / f"m{n}.csv"))
        want = ['x\ny', '6" pipe', "6"][n]
        assert sorted(tuple(r) for r in df.collect()) == [("2", "z"), ('5" pipe', want)]


def test_names_are_compared_as_they_are(spark, tmp_path):
    (tmp_path / "a [b]").mkdir()
    (tmp_path / "a [b]" / "rep[1].csv").write_text("a\n1\n")
    (tmp_path / "rep1.csv").write_text("a\n2\n")
    df = ingest.csv_ingest(spark, str(tmp_path), "rep[1].csv", "named")
    assert [tuple(r) for r in df.collect()] == [(1,)]
    with pytest.raises(FileNotFoundError):
        ingest.find_csv(spark, str(tmp_path), "rep*.csv")


def test_missing_and_repeated_names(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,,A,b\n1,2,3,4\n")
    df = ingest.read_typed_csv(spark, str(tmp_path / "n.csv"))
    assert df.columns == spark.read.csv(str(tmp_path / "n.csv"), header=True).columns and df.count() == 1


def test_a_folder_counts_as_the_file_of_its_name(spark, tmp_path):
    write_csv(spark.range(5).repartition(3), str(tmp_path / "deep" / "numbers.csv"))
    assert ingest.find_csv(spark, str(tmp_path), "numbers.csv").endswith("/deep/numbers.csv")
    assert ingest.csv_ingest(spark, str(tmp_path), "numbers.csv", "numbered", path=str(tmp_path / "table")).count() == 5
    assert (tmp_path / "table").is_dir()


def test_rows_with_surplus_values_are_refused_and_short_ones_filled(spark, tmp_path):
    for n, text in enumerate(["a,_surplus\n1,2\n3,4,5\n", 'a,_surplus\n1,"x\ny"\n3,4,5\n']):
        (tmp_path / f"long{n}.csv").write_text(text)
        with pytest.raises(ValueError, match="more values"):
            ingest.read_typed_csv(spark, str(tmp_path / f"long{n}.csv"))
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    df = ingest.read_typed_csv(spark, str(tmp_path / "short.csv"))
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2.0), (3, None)]
    (tmp_path / "named.csv").write_text("_surplus,_surplus_\n1,2\n")
    assert [tuple(r) for r in ingest.read_typed_csv(spark, str(tmp_path / "named.csv")).collect()] == [(1, 2)]


def test_csv_sink_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y'), (2, None)], "i long, t string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in ingest.read_typed_csv(spark, str(tmp_path / "out")).collect()) == [
        (1, 'say "x", y'), (2, None),
    ]


def test_table_scan_by_name_and_by_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "numbers.parquet"))
    assert table_scan(spark, "numbers", str(tmp_path)).count() == 3
    spark.range(4).write.mode("overwrite").saveAsTable("numbers_table")
    assert table_scan(spark, "numbers_table").count() == 4


def test_jdbc_sink_fails_loudly_without_a_driver(spark):
    with pytest.raises(Exception):
        write_jdbc(spark.range(1), "jdbc:nothing://here", "t")


def test_scratch_folder_is_below_the_shared_one(spark):
    class WithSharedFolder:
        conf = {"spark.checkpoint.dir": "s3://shared/checkpoints/"}
        sql = staticmethod(spark.sql)

    first, second = scratch_folder(WithSharedFolder), scratch_folder(WithSharedFolder)
    assert first.startswith("s3://shared/checkpoints/tallybook-") and first != second


def test_period_params():
    got = period_params({"m": "2024-03", "d": "2024-03-09", "r": "2024-01-01--2024-02-01", "n": ["a", "b"]})
    assert got == {
        "m": datetime.date(2024, 3, 1),
        "d": datetime.date(2024, 3, 9),
        "r": DateRange(datetime.date(2024, 1, 1), datetime.date(2024, 2, 1)),
        "n": ("a", "b"),
    }
