"""Session set-up and table access."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on. Joins may be skewed on any key, so
# adaptive execution must be free to split a hot partition even when that costs
# one more exchange above the join.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and let workers receive this package's functions."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    cloudpickle.register_pickle_by_value(sys.modules["chatloom"])
    return spark


def build(master: str | None = None, cores: int | None = None, app: str = "chatloom") -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    # A superseded round's files go once nothing refers to them.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "12g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder that survives the loss of an executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = getattr(spark, "_chatloom_shared", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="chatloom-")
            spark._chatloom_shared = named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative frame through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: parts that the query tables of texts are dealt out to; unset leaves them as they are read.
PARTS = "chatloom.input.parts"


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out to the parts that the caller asks for in ``PARTS``.

    For small files, which are often one row group and so one task whatever the work
    per row. Files of a cluster have splits enough, so nothing is dealt by default.
    """
    parts = int(df.sparkSession.conf.get(PARTS, "0"))
    return df.repartition(parts) if parts else df
