"""Fetch-cache queries over the event log.

Each event is a fetch request for the resource keyed by ``user_id`` at time
``ts``; an ``error`` event is a fetch that failed (nothing is cached).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.operators import cache as ch
from citeline.operators.prompts import MAX_ATTEMPTS, resolve_responses
from citeline.plans.registry import query
from citeline.sources.tables import read_table


def requests(spark, base):
    ev = read_table(spark, base, "events", "event_id", "ts", "user_id", "event_type")
    return ev.select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("ok"))


SQL_TTL = f"""
WITH RECURSIVE ev AS (
  SELECT user_id AS k, event_id, ts, event_type <> 'error' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
nxt AS (SELECT e.k, e.rn, CASE WHEN any_value(e.ok) THEN min(f.rn) ELSE e.rn + 1 END AS next_miss
        FROM ev e LEFT JOIN ev f ON e.k = f.k AND e.ts + INTERVAL {ch.TTL_HOURS} HOUR <= f.ts
        GROUP BY e.k, e.rn),
miss(k, rn) AS (
  SELECT k, rn FROM ev WHERE rn = 1
  UNION ALL
  SELECT n.k, n.next_miss FROM miss m JOIN nxt n ON n.k = m.k AND n.rn = m.rn WHERE n.next_miss IS NOT NULL)
SELECT ev.event_id, ev.k AS user_id, m.rn IS NULL AS hit
FROM ev LEFT JOIN miss m ON m.k = ev.k AND m.rn = ev.rn"""


@query("cache_ttl", SQL_TTL)
def cache_ttl(spark, base):
    """S3: hit or miss of every request under the anchored 6-hour TTL."""
    out = ch.ttl_hits(requests(spark, base), "user_id", "ts", "event_id", ok="ok")
    return out.select("event_id", "user_id", "hit")


@query("cache_latest", """
SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
       arg_max(props, (ts, event_id)) AS props
FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def cache_latest(spark, base):
    """The cache after all successful writes: last write per key."""
    ev = read_table(spark, base, "events", "event_id", "ts", "user_id", "event_type", "props")
    writes = ev.where(F.col("event_type") != "error").select("user_id", "ts", "event_id", "props")
    return ch.latest_per_key(writes, "user_id", ["ts", "event_id"])


_LOG = {
    "prompt_id": "event_id - event_id % 4",
    "attempt": "CAST(event_id % 4 AS INT)",
    "http_status": "CASE user_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN NULL ELSE 200 END",
    "finished_reason": "CASE WHEN event_type = 'click' THEN 'completed' ELSE 'failed' END",
    "error": "CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN 'Rate limit' ELSE event_type END",
    "text": "CAST(ts AS DATE) || ' ' || event_type"}
_COLUMNS = ", ".join(f"{sql} AS {name}" for name, sql in _LOG.items())


@query("prompt_outcomes", f"""
WITH a AS (SELECT * FROM (SELECT {_COLUMNS} FROM events) WHERE attempt < {MAX_ATTEMPTS}),
k AS (SELECT *, coalesce(http_status BETWEEN 200 AND 299, false) AS answered,
             coalesce(contains(error, '429') OR contains(lower(error), 'rate'), false) AS rate FROM a),
c AS (SELECT *, CASE WHEN answered AND finished_reason = 'completed' THEN 'completed' WHEN http_status = 429 THEN 'rate_limited'
                     WHEN NOT answered THEN 'http_error' WHEN rate THEN 'rate_limited' ELSE 'error' END AS kind FROM k),
r AS (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS attempts,
             row_number() OVER (PARTITION BY prompt_id ORDER BY CASE WHEN kind = 'completed' THEN attempt ELSE 100 - attempt END) AS pick FROM c)
SELECT prompt_id, kind AS status, attempts, CASE WHEN kind = 'completed' THEN text END AS text,
       CASE kind WHEN 'completed' THEN text WHEN 'rate_limited' THEN '[LLM ERROR: max retries exceeded]'
                 WHEN 'http_error' THEN '[BRIDGE ERROR: HTTP ' || coalesce(CAST(http_status AS VARCHAR), 'none') || ']'
                 ELSE '[LLM ERROR: ' || coalesce(error, '') || ']' END AS compat_text
FROM r WHERE pick = 1""")
def prompt_outcomes(spark, base):
    """The outcome of each prompt. Stand-in attempt log: four events in a row are the
    attempts of one prompt; kind and user decide status and error."""
    ev = read_table(spark, base, "events", "event_id", "ts", "user_id", "event_type")
    return resolve_responses(ev.select(*[F.expr(sql).alias(name) for name, sql in _LOG.items()]))
