"""Spark session and shared cluster settings."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. Static size estimates are not trusted for
# broadcasting (an exploded or filtered side can be far larger than estimated):
# AQE converts a join to a broadcast only after the shuffle of that side has
# been measured under the threshold. It also splits skewed join partitions and
# coalesces small shuffle partitions. Fixed literal tables carry explicit hints.
CLUSTER_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "addresskit") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in CLUSTER_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a scratch folder only when unset on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="addresskit-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # static on some deployments; the context setting below is what checkpoint() uses
            pass
    spark.sparkContext.setCheckpointDir(path)
    return path
