"""Fetch by version (S5, C1): a page crawled several times is several rows of the
corpus, and a request sees the version that was valid at its time.

The page table is stored bucketed by (url, version).  Requests find their
version on the narrow columns alone: versions and requests are put in one order
by (url, time) over range partitions, and the latest version is carried
forward (``running.carried_forward``), so a URL that most requests ask for spreads over
many tasks.  Bodies are then joined by the bucketing columns: the HTML is not shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.operators.running import carried_forward
from citeline.operators.sources import ERROR_TEXT
from citeline.session import scratch_path

DEFAULT_BUCKETS = 64


def store_versions(pages: DataFrame, name: str | None = None, path: str | None = None, url: str = "url",
                   version: str = "fetched_at", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``pages`` written once as a table bucketed by (url, version), one file a bucket.

    Rows without url or version take no part.  ``path`` defaults to the shared checkpoint folder."""
    spark = pages.sparkSession
    name = name or f"versions_{uuid.uuid4().hex}"
    rows = pages.where(F.col(url).isNotNull() & F.col(version).isNotNull()).repartition(buckets, url, version)
    (rows.write.mode("overwrite").format("parquet").bucketBy(buckets, url, version).sortBy(url, version)
     .option("path", path or scratch_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def version_as_of(requests: DataFrame, pages: DataFrame, url: str = "url", at: str = "requested_at", version: str = "fetched_at") -> DataFrame:
    """``requests`` with ``version``: that of the latest page row of the URL not after ``at``
    (null if there is none, or if the request has no URL or time).

    Reads only the url and version columns of ``pages``; several rows of one
    version count once.  A column of ``requests`` named like ``version`` is replaced."""
    rest = [c for c in requests.columns if c != version]
    asked = requests.select(F.col(url).alias("_url"), F.col(at).alias("_at"), F.lit(1).alias("_side"),
                            F.lit(None).cast(pages.schema[version].dataType).alias("_version"), F.struct(*rest).alias("_request"))
    known = (pages.where(F.col(version).isNotNull()).select(F.col(url).alias("_url"), F.col(version).alias("_at")).distinct()
             .select("_url", "_at", F.lit(0).alias("_side"), F.col("_at").alias("_version"),
                     F.lit(None).cast(asked.schema["_request"].dataType).alias("_request")))
    timed = F.col("_url").isNotNull() & F.col("_at").isNotNull()
    # a version at the very time of a request is seen by it: versions sort first
    seen = carried_forward(known.unionByName(asked), ["_url"], ["_at", "_side", F.xxhash64("_request")], "_version")
    return (seen.where("_side = 1").withColumn("_version", F.when(timed, F.col("_version")))
            .select(*[F.col("_request")[c].alias(c) for c in rest], F.col("_version").alias(version)))


def fetch_as_of(requests: DataFrame, pages: DataFrame, url: str = "url", at: str = "requested_at", version: str = "fetched_at",
                body: str = "html") -> DataFrame:
    """S5 by version: every request with its ``version``, ``ok`` and ``content`` (an error
    text where no version was known at its time or the version has no body).

    ``pages`` holds one row per (url, version), bucketed by them
    (``store_versions``).  The batch never aborts and keeps every request."""
    found = version_as_of(requests, pages, url, at, version)
    bodies = pages.select(url, version, F.col(body).alias("_body"))
    return (found.join(bodies, [url, version], "left")
            .select(*found.columns, F.col("_body").isNotNull().alias("ok"), F.coalesce("_body", F.lit(ERROR_TEXT)).alias("content")))
