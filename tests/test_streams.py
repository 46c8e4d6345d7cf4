"""Streams over the driver tables: a table is one file or a folder of files, and may be empty."""

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from citeline.plans.catalog import QUERIES
from citeline.streaming.ttl import _decide

PAGES = [(i, f"https://site{i % 3}.example/{i % 8}", f"<html><title>T{i}</title><body><p>Text {i}</p></body></html>") for i in range(10)]


def table(rows):
    ids, urls, pages = zip(*rows) if rows else ((), (), ())
    return pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(pages, pa.string())})


def folder(rows, files):
    base = tempfile.mkdtemp(prefix="streams-", dir="/tmp")
    path = os.path.join(base, "pages.parquet")
    if files == 1:
        pq.write_table(table(rows), path)
        return base
    os.mkdir(path)
    for n in range(files):
        pq.write_table(table(rows[n::files]), os.path.join(path, f"part-{n:04d}.parquet"))
    return base


def rows_of(spark, name, base):
    return sorted(map(tuple, QUERIES[name](spark, base).collect()))


@pytest.mark.parametrize("name", ["page_ingest_stream", "url_dedup_stream"])
def test_table_of_many_files_streams_like_one_file(spark, name):
    one = rows_of(spark, name, folder(PAGES, 1))
    assert len(one) == {"page_ingest_stream": 10, "url_dedup_stream": 2 * len({r[1] for r in PAGES})}[name]
    assert rows_of(spark, name, folder(PAGES, 3)) == one
    assert rows_of(spark, name, "file://" + folder(PAGES, 3) + "/") == one
    assert rows_of(spark, name, folder([], 1)) == []


def events_folder(rows, files):
    base = tempfile.mkdtemp(prefix="streams-", dir="/tmp")
    os.mkdir(os.path.join(base, "events.parquet"))
    for n in range(files):
        ids, stamps, users, kinds = zip(*rows[n::files])
        part = pa.table({"event_id": pa.array(ids, pa.int64()), "ts": pa.array(stamps, pa.timestamp("us")),
                         "user_id": pa.array(users, pa.int64()), "event_type": pa.array(kinds, pa.string())})
        pq.write_table(part, os.path.join(base, "events.parquet", f"part-{n:04d}.parquet"))
    return base


def test_ttl_stream_takes_slices_of_many_files(spark):
    """More files in a slice than one trigger used to take; whole keys above 2**53 stay exact beside a null key."""
    users = [None, 1, 2, 2**60 + 1, 2**60 + 2]
    rows = [(i, 1_700_000_000_000_000 + i * 1_000_000 * 60 * 61, users[i % 5], "error" if i % 7 == 0 else "click") for i in range(480)]
    base = events_folder(rows, 24)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        got = rows_of_events(spark, "cache_ttl_stream", base)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    anchor, want = {}, []
    for i, ts, user, kind in rows:
        hit = user in anchor and ts - anchor[user] < 6 * 3600 * 1_000_000
        if not hit and kind != "error":
            anchor[user] = ts
        want.append((i, user or 0, hit))
    assert got == want and any(hit for _, _, hit in want)


def rows_of_events(spark, name, base):
    return sorted((r.event_id, r.user_id or 0, r.hit) for r in QUERIES[name](spark, base).collect())


def test_one_state_holds_many_keys(spark):
    """Many keys share a few groups and are folded each from its own anchor."""
    t = np.repeat(np.arange(0, 4000, 10), 50) * 1_000_000
    due = pd.DataFrame({"key": np.tile([f"u{i}" for i in range(50)], 400), "rid": np.arange(20000), "ok": np.arange(20000) % 13 != 0, "_us": t})
    ttl, anchors = 100_000_000, pd.DataFrame({"key": ["u7", "gone"], "_anchor": [-50_000_000, -1]})
    out, left = _decide(due, anchors, "key", "rid", "ok", ttl)
    last, want = {"u7": -50_000_000, "gone": -1}, {}
    for key, rid, ok, us in due.itertuples(index=False):
        want[rid] = key in last and us - last[key] < ttl
        if not want[rid] and ok:
            last[key] = us
    assert dict(zip(out["rid"], out["hit"])) == want
    assert dict(zip(left["key"], left["_anchor"])) == last
