"""Anchored TTL cache: batch fold, stream = batch, last write wins (fetch_log)."""

import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeline.operators import cache as ch
from citeline.streaming.ingest import run_to_table
from citeline.streaming.ttl import ttl_stream

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)
S = dt.timedelta(seconds=1)


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, rid long, ok boolean")


def hits(df):
    return {r.rid: r.hit for r in df.collect()}


def test_anchor_boundaries(spark):
    rows = [("k", T0, 1, True), ("k", T0 + 6 * H - S, 2, True), ("k", T0 + 6 * H, 3, True),
            ("k", T0 + 11 * H, 4, True), ("k", T0 + 12 * H - S, 5, True), ("k", T0 + 12 * H, 6, True),
            ("j", T0, 7, False), ("j", T0 + S, 8, True), ("j", T0 + 2 * S, 9, True)]
    got = hits(ch.ttl_hits(log(spark, rows), "key", "ts", "rid", ok="ok"))
    # 2 is a hit; 3 misses at exactly 6 h; hits 4 and 5 do not extend the anchor; 6 misses
    # a failed fetch (7) caches nothing, so 8 misses too
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False, 8: False, 9: True}


def test_hit_chains_do_not_extend(spark):
    rows = [("k", T0 + i * H, i, True) for i in range(20)]
    got = hits(ch.ttl_hits(log(spark, rows), "key", "ts", "rid", ok="ok"))
    assert [i for i, h in sorted(got.items()) if not h] == [0, 6, 12, 18]


def test_hot_key_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = [("hot", T0 + i * 7 * 60 * S, i, i % 13 != 0) for i in range(2000)]
        got = hits(ch.ttl_hits(log(spark, rows), "key", "ts", "rid", ok="ok", partitions=4))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    anchor, want = None, {}
    for _, t, i, ok in rows:                        # brute force
        if anchor is not None and t - anchor < 6 * H:
            want[i] = True
            continue
        want[i] = False
        if ok:
            anchor = t
    assert got == want


def test_stream_equals_batch(spark):
    rows = [(f"u{i % 7}", T0 + i * 37 * 60 * S, i, i % 11 != 0) for i in range(600)]
    d = tempfile.mkdtemp(prefix="ttl-src-", dir="/tmp")
    pdf = pd.DataFrame(rows, columns=["key", "ts", "rid", "ok"])
    for n, part in enumerate([pdf.iloc[:200], pdf.iloc[200:400], pdf.iloc[400:]]):
        part.to_parquet(os.path.join(d, f"part{n}.parquet"), index=False, coerce_timestamps="us")
    src = (spark.readStream.schema("key string, ts timestamp_ntz, rid long, ok boolean")
           .option("maxFilesPerTrigger", 1).parquet(d))
    out = run_to_table(ttl_stream(src, "key", "ts", "rid", "ok"), "test-ttl-" + os.path.basename(d))
    assert hits(out) == hits(ch.ttl_hits(log(spark, rows), "key", "ts", "rid", ok="ok"))


def test_latest_per_key(spark):
    w = spark.createDataFrame([("k", T0, 1, "old"), ("k", T0 + H, 2, "new"), ("k", T0 + H, 1, "tie-lo"),
                               ("j", T0, 5, "only")], "key string, ts timestamp_ntz, seq long, content string")
    got = {r.key: r.content for r in ch.latest_per_key(w, "key", ["ts", "seq"]).collect()}
    assert got == {"k": "new", "j": "only"}


def test_late_requests_over_several_batches_equal_batch(spark):
    """Rows up to two hours late, each file one micro-batch; keys expire and come back."""
    rows = [(f"u{i % 5}", T0 + i * 23 * 60 * S + (i % 5 == 4) * (i // 50) * 9 * H, i, i % 13 != 0) for i in range(450)]
    arrival = sorted(rows, key=lambda r: r[1] + (r[2] * 7919 % 7200) * S)
    end = [("end", max(r[1] for r in rows) + 4000 * H, -1, False)]         # moves the watermark past all
    d = tempfile.mkdtemp(prefix="ttl-late-", dir="/tmp")
    parts = [arrival[:100], arrival[100:150], arrival[150:151], arrival[151:300], arrival[300:], end]
    for n, part in enumerate(parts):
        pd.DataFrame(part, columns=["key", "ts", "rid", "ok"]).to_parquet(os.path.join(d, f"part{n}.parquet"), index=False,
                                                                          coerce_timestamps="us")
        os.utime(os.path.join(d, f"part{n}.parquet"), (1_700_000_000 + n, 1_700_000_000 + n))
    src = (spark.readStream.schema("key string, ts timestamp_ntz, rid long, ok boolean")
           .option("maxFilesPerTrigger", 1).parquet(d)
           .withColumn("ts", F.col("ts").cast("timestamp")))      # event time for the watermark
    out = run_to_table(ttl_stream(src, "key", "ts", "rid", "ok", watermark="3 hours"), "test-ttl-late-" + os.path.basename(d))
    got = out.collect()
    assert len(got) == len(rows) and {r.rid: r.hit for r in got} == brute(rows)


def brute(rows):
    anchor, want = {}, {}
    for k, ts, i, ok in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        a = anchor.get(k)
        if a is not None and ts - a < 6 * H:
            want[i] = True
            continue
        want[i] = False
        if ok:
            anchor[k] = ts
    return want


def adversarial():
    """Interleaved chains, failure runs, long pauses, and keys that never pause for six hours."""
    rows = [("k", T0, 1, True), ("k", T0 + 6 * H - S, 2, True), ("k", T0 + 6 * H, 3, True),
            ("k", T0 + 11 * H, 4, True), ("k", T0 + 12 * H - S, 5, True), ("k", T0 + 12 * H, 6, True),
            ("j", T0, 7, False), ("j", T0 + S, 8, True), ("j", T0 + 2 * S, 9, True)]
    rows += [("hot", T0 + i * 7 * 60 * S, 100 + i, i % 13 != 0) for i in range(2000)]
    rows += [("dense", T0 + i * S, 20_000 + i, i % 5 != 0) for i in range(3000)]        # many stretches within one TTL
    rows += [("every3h", T0 + i * 3 * H, 5000 + i, True) for i in range(60)]
    rows += [("fails", T0 + i * 20 * 60 * S, 6000 + i, i % 40 > 25) for i in range(300)]
    rows += [(None, T0 + i * H, 40_000 + i, True) for i in range(50)]
    rows += [("never", T0 + i * 60 * S, 50_000 + i, False) for i in range(500)]
    t = T0
    for i in range(1500):
        t += 7 * H if i % 97 == 0 else 13 * 60 * S
        rows.append(("gappy", t, 9000 + i, i % 17 != 0))
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 8, 61, 200])
def test_ttl_over_any_number_of_ranges_matches_brute_force(spark, partitions):
    rows = adversarial()
    assert hits(ch.ttl_hits(log(spark, rows), "key", "ts", "rid", ok="ok", partitions=partitions)) == brute(rows)


def test_busy_key_spreads_over_many_tasks(spark):
    rows = [("hot", T0 + i * 7 * 60 * S, i, i % 13 != 0) for i in range(5000)]       # no six-hour pause at all
    ranged = log(spark, rows).repartitionByRange(16, "key", "ts", "rid")
    sizes = [r[1] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1000
    got = ch.ttl_hits(log(spark, rows), "key", "ts", "rid", ok="ok", partitions=16)
    assert hits(got) == brute(rows)


def test_stretch_functions_compose():
    rng = np.random.default_rng(5)
    ttl = 100
    for trial in range(300):
        n = int(rng.integers(2, 60))
        t = np.sort(rng.integers(0, int(rng.choice([30, 300, 1500])), n)) + 1000
        good = rng.random(n) < rng.choice([0.2, 0.9])
        cuts = sorted(set(rng.integers(1, n, 3).tolist())) + [n]
        parts, lo = [], 0
        for hi in cuts:
            parts.append(ch.stretch_table(t[lo:hi], good[lo:hi], ttl, False))
            lo = hi
        whole = parts[0]
        for part in parts[1:]:
            whole = ch.compose(whole, part, ttl)
        for anchor in [None, *range(int(t[0]) - ttl, int(t[0]), 7)]:
            expires = ch.NO_ANCHOR if anchor is None else anchor + ttl
            out = whole[1][min(int(np.searchsorted(whole[0], expires)), len(whole[1]) - 1)]
            want = ch.fold_key(t, good, anchor, ttl)[2]
            got = anchor if out == ch.SAME else None if out == ch.NO_ANCHOR else int(out)
            if got is None:      # an expired anchor decides like none
                assert want is None or want + ttl <= t[-1]
            else:
                assert got == want


def test_empty_request_table(spark):
    assert ch.ttl_hits(log(spark, []), "key", "ts", "rid", ok="ok").collect() == []
