"""Streaming queries: the driver tables read as file streams, run with an
available-now trigger into tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeline.plans import sqltext as sq
from citeline.plans.events import SQL_TTL, requests
from citeline.plans.pages import SOURCE_CONTENT_MAX
from citeline.plans.registry import query
from citeline.plans.web import SQL_REQUESTS, requests as url_requests
from citeline.session import scratch_path, written
from citeline.sources.tables import read_table
from citeline.streaming.ingest import ingest_pages, page_stream, run_to_table, table_path
from citeline.streaming.registry import SourceRegistry
from citeline.streaming.ttl import ttl_stream

LATENESS = 2 * 3600 * 1_000_000     # µs by which stand-in requests arrive after their time, at most
SLICES = 5


def late_requests(spark, base):
    """Stand-in arrivals: the event log cut into ``SLICES`` slices by arrival, out of time order by up
    to ``LATENESS``; a last slice with one distant row moves the watermark past all."""
    ev = requests(spark, base).withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATENESS))
    lo, hi = ev.agg(F.min(arrival), F.max(arrival)).first()
    span = max(1, (hi or 0) - (lo or 0)) + 1
    cut = written(ev.withColumn("slice", F.floor((arrival - (lo or 0)) * SLICES / span)), "arrivals")
    end = ev.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).where("ts is not null")
    none = [F.lit(None).cast(ev.schema[c].dataType).alias(c) for c in ("event_id", "user_id")]
    return cut.unionByName(end.select(none[0], "ts", none[1], F.lit(False).alias("ok"), F.lit(SLICES).cast("long").alias("slice")))


@query("cache_ttl_stream", SQL_TTL)
def cache_ttl_stream(spark, base):
    """ST1: the anchored TTL cache evaluated by a stateful stream over the event log, with
    late requests in several micro-batches, a watermark and expiring state. Each slice is one batch of
    the restarted stream, however many files it has: a part of one would move the watermark past the rest."""
    tag = uuid.uuid4().hex
    arriving, path = late_requests(spark, base), scratch_path(spark, f"late-{tag}")
    for part in range(SLICES + 1):
        arriving.where(F.col("slice") == part).drop("slice").write.mode("append").parquet(path)
        stream = spark.readStream.schema(arriving.drop("slice").schema).parquet(path)
        out = run_to_table(ttl_stream(stream, "user_id", "ts", "event_id", "ok", watermark="3 hours"), f"ttl-{tag}")
    return out.where("event_id is not null").select("event_id", "user_id", "hit")


@query("page_ingest_stream", f"""
SELECT page_id, url, {sq.title('html')} AS title, {sq.description('html')} AS description,
       {sq.publish_date('html')} AS publish_date,
       {sq.main_compat(sq.clean('html'), SOURCE_CONTENT_MAX)} AS content
FROM pages""")
def page_ingest_stream(spark, base):
    """ST3: pages arriving as files are extracted incrementally."""
    # the driver tables are one row group per file: spread each batch over the task slots
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = run_to_table(ingest_pages(page_stream(spark, table_path(base, "pages"), "*", spread_to=slots), SOURCE_CONTENT_MAX),
                       f"ingest-{uuid.uuid4().hex}")
    return out.select("page_id", "url", "title", "description", "publish_date", "content")


@query("url_dedup_stream", f"""
SELECT DISTINCT research_id, url FROM (
  SELECT {sq.site('url')} AS research_id, url FROM pages
  UNION ALL SELECT {sq.site('url')}, url || '#missing' FROM pages)""")
def url_dedup_stream(spark, base):
    """ST2: first-seen URL dedup per run on a request stream (each page URL
    is requested twice and a missing URL once per page)."""
    from citeline.plans.pages import site_col
    from citeline.plans.web import MISSING
    from citeline.streaming.ingest import first_seen_stream

    p = page_stream(spark, table_path(base, "pages"), "*").withColumn("research_id", site_col())
    req = (p.select("research_id", "url")
           .unionByName(p.select("research_id", "url"))
           .unionByName(p.select("research_id", F.concat("url", F.lit(MISSING)).alias("url"))))
    out = run_to_table(first_seen_stream(req, ["research_id", "url"]), f"dedup-{uuid.uuid4().hex}")
    return out.select("research_id", "url")


ARRIVALS = 3
_SEEN = f"""
WITH a AS (SELECT *, (seq + step) % {ARRIVALS} AS batch_id FROM ({SQL_REQUESTS})),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY research_id, url ORDER BY batch_id, step, seq) = 1),
held AS (SELECT f.*, EXISTS (SELECT 1 FROM pages p WHERE p.url = f.url) AS ok FROM f)
SELECT research_id, url, step, seq, batch_id::BIGINT AS batch_id,
       CASE WHEN ok THEN count(*) FILTER (WHERE ok) OVER (PARTITION BY research_id ORDER BY batch_id, step, seq) END AS citation_index
FROM held"""


@query("source_registry_stream", _SEEN)
def source_registry_stream(spark, base):
    """ST2+U3+C1+C2: the source registry grown by a request stream. The requests arrive in
    three parts, each of which the restarted stream takes as its next batch."""
    tag = uuid.uuid4().hex
    asked = url_requests(spark, base).withColumn("part", F.pmod(F.col("seq") + F.col("step"), F.lit(ARRIVALS)))
    path, corpus = scratch_path(spark, f"asked-{tag}"), read_table(spark, base, "pages", "url")
    registry = SourceRegistry(spark, f"registry_{tag}")
    for part in range(ARRIVALS):
        asked.where(F.col("part") == part).drop("part").write.mode("append").parquet(path)
        arriving = spark.readStream.schema(asked.drop("part").schema).parquet(path)
        registry.follow(arriving, corpus, scratch_path(spark, f"registry-stream-{tag}"))
    return registry.rows()
