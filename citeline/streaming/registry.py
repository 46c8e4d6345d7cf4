"""ST2 with U3, C1 and C2 as a table: the registry of requested URLs, grown batch by batch.

A micro-batch of requests is compared with the registry written by earlier
batches (left anti join on its bucketing columns: the registry is not shuffled) and
its new URLs are added, numbered from the highest number of their run on.
The stream itself keeps no state.  A batch owns the partition of its id: it
reads only partitions of smaller ids and replaces its own, so a batch that is run
again after a lost driver writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.operators.ordering import first_seen, number_within
from citeline.session import scratch_path, written

DEFAULT_BUCKETS = 32


class SourceRegistry:
    """The registry table ``name`` in ``path`` (default: the shared checkpoint folder).

    Columns: ``research_id``, ``url``, ``step``, ``seq`` (of the request that was
    first), ``citation_index`` (dense per run; null where the corpus has
    no such page) and ``batch_id``.  A table that is there already is opened with its partitions.
    """

    SCHEMA = "research_id STRING, url STRING, step INT, seq BIGINT, citation_index BIGINT"

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = DEFAULT_BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets
        path, columns = path or scratch_path(spark, name), f"{self.SCHEMA}, batch_id BIGINT"
        spark.createDataFrame([], columns).write.partitionBy("batch_id").mode("append").parquet(path)  # the folder must be there
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (batch_id) "
                  f"CLUSTERED BY (research_id, url) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows, or those of batches with an id below ``before``."""
        table = self.spark.table(self.name)
        return table if before is None else table.where(F.col("batch_id") < before)

    def fresh(self, requests: DataFrame, batch_id: int) -> DataFrame:
        """The first request of every (run, URL) that no earlier batch asked for, by step
        and seq.  Requests without run or URL are left out."""
        given = requests.where("research_id is not null and url is not null").select("research_id", "url", "step", "seq")
        first = first_seen(given, ["research_id", "url"], ["step", "seq"])
        known = self.rows(before=batch_id).select("research_id", "url")
        return first.join(known, ["research_id", "url"], "left_anti")

    def register(self, requests: DataFrame, corpus: DataFrame, batch_id: int) -> None:
        """Add one batch: a URL is seen from its first request on, whether ``corpus`` has it
        or not; those it has get the next numbers of their run."""
        new = written(self.fresh(requests, batch_id), "fresh")
        held = corpus.select("url").join(new.select("url").distinct(), "url", "left_semi").distinct()
        runs = new.select("research_id").distinct()
        high = (self.rows(before=batch_id).select("research_id", "citation_index").join(runs, "research_id", "left_semi")
                .groupBy("research_id").agg(F.max("citation_index").alias("_high")))
        numbers = number_within(new.join(held, "url", "left_semi"), ["research_id"], ["step", "seq", "url"], "_number")
        numbers = (numbers.join(high, "research_id", "left")
                   .select("research_id", "url", (F.col("_number") + F.coalesce("_high", F.lit(0))).alias("citation_index")))
        out = (new.join(numbers, ["research_id", "url"], "left")
               .select("research_id", "url", F.col("step").cast("int"), F.col("seq").cast("long"), "citation_index"))
        # written apart first: Spark does not overwrite a table that the same plan reads
        placed = written(out, "batch").repartition(self.buckets, "research_id", "url")
        placed.sparkSession.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch_id = {int(batch_id)}) SELECT * FROM {{rows}}",
                                rows=placed)

    def follow(self, stream: DataFrame, corpus: DataFrame, checkpoint: str) -> None:
        """Register everything that ``stream`` has available now; a later call with
        the same ``checkpoint`` goes on behind it."""
        query = (stream.writeStream.foreachBatch(lambda batch, batch_id: self.register(batch, corpus, batch_id))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
