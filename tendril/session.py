"""Session helpers.

Library code never builds its own session; it takes the one it is given.
``local_session`` is for tests, the bench and the smoke entry only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (all timestamps are
# timestamp_ntz, "as of" values are compared as naive times), AQE with skew
# handling for the fact -> plant joins.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Suggested settings for a large cluster (about 100 TB of facts): many initial
# shuffle partitions that AQE coalesces to ~256 MB, larger file splits, skew
# splitting on.  Library code does not set these; pass them to spark-submit.
CLUSTER_SUGGESTED = {
    **SQL_DEFAULTS,
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.tendril.skew.targetRows": "2000000",
    "spark.tendril.broadcast.maxRows": "100000",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tendril") -> SparkSession:
    """A local[N] session for tests and the bench (UI off, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tendril-warehouse-"))
    )
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting is given and is only read here. Where it is unset
    (local tests) a fresh scratch folder is taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="tendril-ckpt-")  # local runs only
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # some deployments refuse to change core settings at run time
            pass
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder (streaming state, cut tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
