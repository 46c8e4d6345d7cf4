"""Scans of the corpus tables (S1) with column pruning and parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan of one table; listing ``columns`` prunes the read schema."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give text-heavy work enough tasks.

    A corpus stored as a few large files yields fewer scan splits than task
    slots; only then are rows redistributed (round robin, no key, so no skew).
    A corpus of many files is left as scanned: no extra shuffle.
    """
    spark = df.sparkSession
    want = min_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have < want else df
