"""CSV files with one type per column, chosen from all of the data."""

import csv
import io
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.constants import CSV_MISSING_TEXTS
from tallybook.session import scratch_folder
from tallybook.sources.tables import write_table

# Spellings of the four data types, in the order they are tried.
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?(((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)|([iI]nf(inity)?))\s*$"
BOOLEAN_PATTERN = r"^(True|TRUE|true|False|FALSE|false)$"

# Lines that the first record of a file may have.
HEADER_LINES = 1000

OPTIONS = {"quote": '"', "escape": '"', "multiLine": True}


def find_csv(spark: SparkSession, root: str, name: str) -> str:
    """Path of the file of exactly that name nearest to the root folder, or of the folder of part files that is called so."""
    parts = F.split("path", "/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(literal_path(root)).select("path")
    found = listed.withColumn("in_folder", F.element_at(parts, -1) != name).filter(
        ~F.col("in_folder") | ((F.size(parts) > 1) & (F.try_element_at(parts, F.lit(-2)) == name))
    )
    path = F.when(F.col("in_folder"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(F.col("path"))
    first = found.select(path.alias("path")).orderBy(F.size(parts), "path").first()
    if first is None:
        raise FileNotFoundError(f"no file {name!r} below {root!r}")
    return first["path"]


def literal_path(path: str) -> str:
    """The path with the characters of file patterns taken as they are."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the block of it that they begin in, their order in the block, and whether quotes are odd there."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        (quotes % 2).alias("odd"),
        "value",
    )


def split_records(lines: DataFrame) -> DataFrame:
    """``value``, the text of every record but each file's first, of ``lines`` as stored by :func:`read_text_columns`.

    A line that follows an even number of quotes in its file begins a record. Quotes are summed up per block, the sums
    over the blocks of a file, and again within a block, so blocks are split side by side. Only the records that
    cross a block's end, at most two for each block, are put together across blocks.
    """
    place = ["file", "block"]
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd_blocks = lines.groupBy(*place).agg((F.sum("odd") % 2).alias("odd_block"))
    blocks = odd_blocks.withColumn("before", F.coalesce(F.sum("odd_block").over(in_file), F.lit(0)))
    in_block = Window.partitionBy(*place).orderBy("line")
    earlier, so_far = (in_block.rowsBetween(Window.unboundedPreceding, to) for to in (-1, Window.currentRow))
    placed = (
        lines.join(blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "before", "odd_block"),
                   (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
        .withColumn("inside", (F.col("before") + F.coalesce(F.sum("odd").over(earlier), F.lit(0))) % 2)
        .withColumn("open_end", (F.col("before") + F.col("odd_block")) % 2)
        .withColumn("record", F.sum(1 - F.col("inside")).over(so_far))
        .withColumn("goes_on", F.coalesce(F.lead("inside").over(in_block), "open_end"))
        .withColumn("last", F.max("record").over(Window.partitionBy(*place)))
    )
    crossing = (F.col("record") == 0) | ((F.col("record") == F.col("last")) & (F.col("open_end") == 1))
    alone = (F.col("inside") == 0) & (F.col("goes_on") == 0)
    columns = ["file", "block", "record", "value"]
    single = placed.filter(~crossing & alone).select(*columns)
    several = _put_together(placed.filter(~crossing & ~alone), ["file", "block", "record"], "line")
    pieces = _put_together(placed.filter(crossing), ["file", "block", "record"], "line")
    chains = Window.partitionBy("file").orderBy("block", "record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = pieces.withColumn("chain", F.sum(F.when(F.col("record") > 0, 1).otherwise(0)).over(chains)).withColumn(
        "at", F.struct("block", "record")
    )
    across = _put_together(chained, ["file", "chain"], "at", F.min("at").alias("first")).select(
        "file", "first.block", "first.record", "value"
    )
    records = single.unionByName(several.select(*columns)).unionByName(across)
    body = records.filter((F.col("block") > 0) | (F.col("record") > 1))
    return body.select(F.regexp_replace("value", "\r$", "").alias("value")).filter(F.col("value") != "")


def _put_together(lines: DataFrame, keys: list[str], order: str, *more: Column) -> DataFrame:
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, "value"))), lambda x: x["value"])
    return lines.groupBy(*keys).agg(F.array_join(texts, "\n").alias("value"), *more)


def _has_quotes_in_plain_values(records: DataFrame) -> bool:
    """Whether quotes are left when escaped quotes and quoted values are taken away."""
    unescaped = F.replace(F.col("value"), F.lit('""'), F.lit(""))
    rest = F.regexp_replace(unescaped, r'(?<![^,])"[^"]*+"(?![^,])', "")
    return not records.filter(F.contains(rest, F.lit('"'))).isEmpty()


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first record of the first file. Missing names and repeated ones are told apart by their place."""
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no file at {path!r}")
    lines = spark.read.option("lineSep", "\n").text(literal_path(first)).take(HEADER_LINES)
    names = next(csv.reader(io.StringIO("\n".join(r.value for r in lines), newline="")), [])
    known = Counter(name.lower() for name in names)
    return [name + (str(n) if known[name.lower()] > 1 else "") if name else f"_c{n}" for n, name in enumerate(names)]


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, missing values as NULL, short rows filled up with NULL.

    The last column holds the first value that a row has beyond the header's columns. Lines end with ``\\n`` or
    ``\\r\\n``. The file is split among tasks, also if quoted values hold line breaks: then its lines are stored once
    and split into records by :func:`split_records`. Files against the format, with quotes within plain values or
    without a closing one, cannot be split so: each is read by one task if it has lines with odd quotes.
    """
    names = _header(spark, path)
    surplus = "_surplus"
    while surplus in names:
        surplus += "_"
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*names, surplus)])
    lines = _lines(spark, path)
    whole_records = lines.filter(F.col("odd") == 1).isEmpty()
    options = {"header": True, "enforceSchema": True, **OPTIONS, "multiLine": not whole_records}
    raw = spark.read.options(**options).schema(schema).csv(path)
    if not whole_records:
        folder = scratch_folder(spark)
        # The blocks depend on the cores at hand when a file is read, so they are stored with the lines.
        lines.write.parquet(f"{folder}/lines")
        lines = spark.read.parquet(f"{folder}/lines")
        unclosed = lines.groupBy("file").agg(F.sum("odd").alias("quotes")).filter(F.col("quotes") % 2 == 1)
        split_records(lines).write.parquet(f"{folder}/records")
        records = spark.read.schema("value string").parquet(f"{folder}/records")
        if unclosed.isEmpty() and not _has_quotes_in_plain_values(records):
            columns = ", ".join(f"c{n} STRING" for n in range(len(schema)))
            raw = records.select(F.from_csv("value", columns, OPTIONS).alias("row")).select("row.*").toDF(*schema.names)
    missing = list(CSV_MISSING_TEXTS)
    return raw.select(
        *[F.when(~_quoted(c).isin(missing), _quoted(c)).alias(c) for c in names], surplus
    )


def infer_types(text: DataFrame) -> dict[str, T.DataType]:
    """One type per column but the last, from a single pass that counts how many values fit each type.

    Raises if a row has more values than there are columns.

    Whole numbers are BIGINT, but DOUBLE if values are missing; other numbers and columns
    without any value are DOUBLE; true/false without gaps is BOOLEAN; all else, dates
    too, stays text. Whole numbers beyond 64 bits stay text to keep their digits.
    """
    counts = [F.count(F.lit(1)).alias("rows"), F.count(text.columns[-1]).alias("surplus")]
    names = text.columns[:-1]
    for n, name in enumerate(names):
        value = _quoted(name)
        whole = value.rlike(INTEGER_PATTERN)
        counts += [
            F.count(value).alias(f"present_{n}"),
            F.count(F.when(whole & F.trim(value).try_cast("long").isNotNull(), 1)).alias(f"whole_{n}"),
            F.count(F.when(whole & F.trim(value).try_cast("long").isNull(), 1)).alias(f"huge_{n}"),
            F.count(F.when(value.rlike(FLOAT_PATTERN), 1)).alias(f"number_{n}"),
            F.count(F.when(value.rlike(BOOLEAN_PATTERN), 1)).alias(f"boolean_{n}"),
        ]
    row = text.agg(*counts).first()
    if row["surplus"]:
        raise ValueError(f"{row['surplus']} rows have more values than the header has columns")
    types: dict[str, T.DataType] = {}
    for n, name in enumerate(names):
        present = row[f"present_{n}"]
        complete = present == row["rows"]
        if complete and present and row[f"whole_{n}"] == present:
            types[name] = T.LongType()
        elif row[f"number_{n}"] == present and not row[f"huge_{n}"]:
            types[name] = T.DoubleType()
        elif complete and row[f"boolean_{n}"] == present:
            types[name] = T.BooleanType()
        else:
            types[name] = T.StringType()
    return types


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or a folder of them, with inferred types."""
    text = read_text_columns(spark, path)
    types = infer_types(text)

    def typed(name: str) -> Column:
        value = _quoted(name)
        if isinstance(types[name], T.StringType):
            return value.alias(name)
        return F.trim(value).cast(types[name]).alias(name)

    return text.select(*[typed(name) for name in types])


def csv_ingest(
    spark: SparkSession, root: str, name: str, table: str, mode: str = "overwrite", path: str | None = None
) -> DataFrame:
    """Find a CSV file below a folder and load it as a table, replacing an earlier one.

    Errors are raised; nothing is replaced unless the file was found and read. The table's data go to ``path``, if given.
    """
    found = literal_path(find_csv(spark, root, name))
    write_table(read_typed_csv(spark, found), table, mode, path=path)
    return spark.table(table)
