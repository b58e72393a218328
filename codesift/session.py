"""Session defaults, the shared work folder and size checks for broadcasts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes up to which a side may be held by every task.  A side beyond
# either bound takes the shuffled path of the operator that asked.
MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "codesift", master: str | None = None) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    ``hugeMethodLimit`` keeps very wide rule expressions in JIT-sized methods.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.driver.memory": os.environ.get("CODESIFT_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``.  Only a local master may
    run without it; then a folder inside the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps
    start from files that outlive lost executors."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: it is never sent whole through the driver to all tasks."""
    return df.hint("merge")


def collect_bounded(df: DataFrame, bytes_per_row: int):
    """``df`` as a pandas frame when it is within the bound, else None.  At most
    one row beyond the bound is ever fetched."""
    bound = min(MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES // max(bytes_per_row, 1))
    pdf = df.limit(bound + 1).toPandas()
    return pdf if len(pdf) <= bound else None


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a scan yields fewer partitions than the cluster has
    cores (one small file is one partition).  Large inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
