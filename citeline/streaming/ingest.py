"""ST2 and ST3: streaming first-seen dedup and incremental page ingest, plus
the runner that drives a stream to completion into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeline.operators.pages import extract_pages
from citeline.session import scratch_path

PAGES_SCHEMA = "page_id long, url string, html string"


def first_seen_stream(requests: DataFrame, keys: list[str], ts: str | None = None,
                      delay: str | None = None) -> DataFrame:
    """ST2 (U3 on a stream): keep the first request of every key.

    Without ``ts`` the dedup state keeps every key forever (exact);
    with ``ts``/``delay`` only duplicates within the watermark delay are
    removed (bounded state)."""
    if ts and delay:
        return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return requests.dropDuplicates(keys)


def table_path(base: str, name: str) -> str:
    """The table ``name`` in ``base``, one file or a folder of files, as a pattern: a stream
    takes a single file only by a pattern, and a file name filter misses the files of a folder."""
    return f"{base.rstrip('/')}/{name}.parque[t]"


def page_stream(spark: SparkSession, directory: str, glob: str = "*.parquet",
                max_files: int | None = None, spread_to: int | None = None) -> DataFrame:
    """S1 on a stream: pages arriving as parquet files in ``directory`` (a path or a pattern of paths);
    ``glob`` filters file names.

    ``spread_to`` redistributes each micro-batch round robin before the
    CPU-bound extraction; use it when batches consist of a few large files
    (one parquet row group is one task), leave it off when they span many."""
    r = spark.readStream.schema(PAGES_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.parquet(directory)
    return df.repartition(spread_to) if spread_to else df


def ingest_pages(pages: DataFrame, max_chars: int = 5000) -> DataFrame:
    """ST3: stateless extraction (T3, T7, T12) of every arriving page."""
    return extract_pages(pages, "html", max_chars).drop("html")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now into a parquet table in
    the shared checkpoint folder (exactly-once file sink, restartable from
    its checkpoint) and return the table as a batch DataFrame."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, f"{name}/data"), scratch_path(spark, f"{name}/_checkpoint")
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)     # a stream without rows leaves no file to take the schema from
