"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "millrace", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a private folder only where none is set, as in tests."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def numbered(df: DataFrame, order: list[str], first: int, name: str) -> DataFrame:
    """df, cut, with consecutive numbers from first on in the given order; counted per range of the order, so no task sees all rows."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)  # the id holds the range in its upper bits and the place within it below
    start, total = {}, first
    for p, n in sorted((r["_p"], r["count"]) for r in placed.groupBy(part.alias("_p")).count().collect()):  # a row for each range
        start[p], total = total, total + n
    if not start:
        return placed.withColumn(name, F.lit(first).cast("long")).drop("_m")
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in start.items() for x in pair]), part)
    return placed.withColumn(name, (offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_m")


#: Rows of fixed-width keys up to which a set is broadcast.
BROADCAST_ROWS = 2_000_000


def small_or_shuffled(keys: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """keys, marked for broadcast if its counted rows stay within the bound; keys must be cheap to read again, as a checkpoint is."""
    return F.broadcast(keys) if keys.count() <= bound else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
