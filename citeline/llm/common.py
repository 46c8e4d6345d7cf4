"""Shared helpers: scratch tables in the shared checkpoint folder, connected
components, and table reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most this many rows may be broadcast (one to five longs each: up to about 60 MB).
BROADCAST_ROWS = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests); a cluster must name
    a folder that the driver and all executors share.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        path = tempfile.mkdtemp(prefix="citeline-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads the files), evaluates expensive
    inputs once, and gives later joins exact sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are at most ``rows``;
    otherwise unchanged (the join shuffles both sides).  ``df`` should be a
    materialized key table of a few fixed-width columns."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` -> ``(node, component_id)`` with
    the smallest node reachable.  Nodes without edges do not appear.

    Minimum labels travel over the edges and then jump to the label's own
    label, so a round at least halves long chains of labels; every round is a
    written table.  No group is gathered: minima are partial aggregates.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        .select("node", F.least("node", "b").alias("component_id"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        old = labels.select("node", "component_id")
        near = (both.join(old.select(F.col("node").alias("b"), F.col("component_id").alias("c")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c")))
        hooked = old.join(near, "node").select("node", F.col("component_id").alias("before"),
                                               F.least("component_id", "c").alias("c"))
        jump = old.select(F.col("node").alias("c"), F.col("component_id").alias("root"))
        labels = materialize(
            hooked.join(jump, "c").select("node", F.least("c", "root").alias("component_id"),
                                          (F.least("c", "root") < F.col("before")).alias("changed")), "labels")
    return labels.select("node", "component_id")
