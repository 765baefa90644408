"""Runtime settings the plans count on, and the shared scratch folder."""

import tempfile

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the settings above; all can be changed on a running session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on this machine alone, as in tests, a folder of this machine is made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="tallybook-")
    token = spark.sql("SELECT uuid()").first()[0]
    return f"{shared.rstrip('/')}/tallybook-{token}"
