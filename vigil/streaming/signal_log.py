"""The append-only signal log as a stream: late and repeated observations, windowed counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deduplicated(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (item, type, time) once, within the watermark."""
    return log.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["vuln_id", "signal_type", "observed_at"])


def windowed_counts(log: DataFrame, length: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Signals by window and type."""
    rows = log.withWatermark("observed_at", delay).groupBy(F.window("observed_at", length), "signal_type")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce("value_bool", F.lit(False))).alias("raised")).select(
        F.col("window.start").alias("window_start"), "signal_type", "n", "raised"
    )


def stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's state and output under the cluster's shared checkpoint folder; only a local master may do without one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='vigil-stream-')}/stream-{uuid.uuid4().hex}"
