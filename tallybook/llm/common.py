"""Reading the given tables and passing intermediate tables through the shared folder."""

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import scratch_folder

# The white space that separates words, as a Java character class body.
SPACES = r" \t-\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


class Scratch:
    """A folder below ``spark.checkpoint.dir`` for the tables of one run.

    A table written there cuts the lineage: a lost executor costs only its running tasks.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, scratch_folder(spark), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def tagged(docs: DataFrame, name: str = "_tag") -> DataFrame:
    """``docs``, a scan of Parquet files, with ``name``: the file a row is in and its number there.

    It tells repeated rows apart and belongs to the stored row, so every read gives the same, whatever cores are at hand
    and however Spark packs files into tasks. Store anything but a scan first.
    """
    file = F.lpad(F.hex(F.xxhash64("_metadata.file_path")), 16, "0")
    return docs.withColumn(name, F.concat(file, F.lpad(F.hex("_metadata.row_index"), 12, "0")))


def unused_name(docs: DataFrame, name: str) -> str:
    """``name``, prolonged until no column of ``docs`` is called so."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


# Rows that Python tasks get at a time, and bytes of them: some MB of text, also where texts are long.
ARROW_ROWS = 2000
ARROW_BYTES = 4 << 20

_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """What this Python worker keeps for its later tasks, made if need be: one thing at a time.

    Spark hands a worker on to the tasks of other operators; what the one before has learned would stay beside theirs.
    """
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what another operator's tasks have left in this Python worker. A task that holds nothing begins with this."""
    _HELD.clear()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each Spark context, and keep the batches of Python tasks small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if getattr(context, "_tallybook_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver serves this file to the executors as long as the context lives.
    folder = tempfile.mkdtemp(prefix="tallybook-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tallybook-code.zip")
    with zipfile.ZipFile(path, "w") as code:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    code.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    context._tallybook_shipped = True
