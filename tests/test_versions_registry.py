"""Fetch by version and the registry grown by batches, against brute force."""

import datetime as dt
import random
import uuid

from citeline.operators.sources import ERROR_TEXT
from citeline.operators.versions import fetch_as_of, store_versions, version_as_of
from citeline.session import scratch_path
from citeline.streaming.registry import SourceRegistry

START = dt.datetime(2024, 1, 1)
REQUESTS = "research_id string, url string, step int, seq long"


def minutes(n):
    return START + dt.timedelta(minutes=n)


def version_rows(rng):
    found = sorted({(rng.choice("aaab"), minutes(rng.randrange(200))) for _ in range(60)})
    return [(u, t, None if i % 9 == 0 else f"{u}{t}") for i, (u, t) in enumerate(found)]


def test_every_request_sees_the_version_of_its_time(spark):
    rng = random.Random(3)
    versions = version_rows(rng)
    pages = store_versions(spark.createDataFrame([*versions, (None, START, "x"), ("a", None, "x")],
                                                 "url string, fetched_at timestamp, html string"), buckets=4)
    assert pages.count() == len(versions)
    asked = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None] + [minutes(rng.randrange(-5, 210))] * 9)) for i in range(400)]
    asked += [(1000, *versions[5][:2])] * 2                     # at the very time of a version; a repeated row
    frame = spark.createDataFrame(asked, "id long, url string, requested_at timestamp")
    got = fetch_as_of(frame.selectExpr("*", "'z' as fetched_at"), pages).collect()
    assert len(got) == len(asked)
    body = {(u, t): h for u, t, h in versions}
    for r in got:
        want = max((t for u, t, _ in versions if u == r.url and r.requested_at is not None and t <= r.requested_at), default=None)
        assert r.fetched_at == want
        assert (r.ok, r.content) == (body.get((r.url, want)) is not None, body.get((r.url, want)) or ERROR_TEXT)
    assert [r.fetched_at for r in got if r.id == 1000] == [versions[5][1]] * 2
    assert fetch_as_of(frame.limit(0), pages).collect() == []
    none = version_as_of(frame, pages.limit(0)).collect()
    assert len(none) == len(asked) and all(r.fetched_at is None for r in none)


def test_bodies_are_not_shuffled(spark):
    pages = store_versions(spark.createDataFrame(version_rows(random.Random(4)), "url string, fetched_at timestamp, html string"), buckets=4)
    asked = spark.createDataFrame([(1, "a", START)], "id long, url string, requested_at timestamp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fetch_as_of(asked, pages)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)
    below = plan[plan.index("SortMergeJoin [url"):].split("\n")
    side = next(i for i, line in enumerate(below) if "_body" in line and "Project" in line and i)
    assert not any("Exchange" in line for line in below[side - 1:])  # the last branch is the bodies' scan
    assert any("FileScan" in line and "html" in line and "Bucketed: true" in line for line in below[side:])


def registered(batches, held):
    seen, high = {}, {}
    for i, batch in enumerate(batches):
        best = {}
        for run, url, step, seq in batch:
            if run is not None and url is not None and (run, url) not in seen:
                best[run, url] = min(best.get((run, url), (step, seq)), (step, seq))
        for (run, url), (step, seq) in sorted(best.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
            if url in held:
                high[run] = high.get(run, 0) + 1
            seen[run, url] = (run, url, step, seq, high[run] if url in held else None, i)
    return sorted(seen.values(), key=str)


def rows_of(registry):
    return sorted(map(tuple, registry.rows().collect()), key=str)


def test_registry_numbers_go_on_and_a_replayed_batch_changes_nothing(spark):
    rng = random.Random(5)
    batches = [[(rng.choice(["r", "r", "s", None]), rng.choice([f"u{rng.randrange(40)}"] * 9 + [None]), rng.randrange(3), rng.randrange(1000))
                for _ in range(60)] for _ in range(3)]
    held = {f"u{i}" for i in range(0, 40, 2)}
    corpus = spark.createDataFrame([(u,) for u in sorted(held)] + [("u0",)], "url string")
    name = f"registry_{uuid.uuid4().hex}"
    registry = SourceRegistry(spark, name, buckets=4)
    frames = [spark.createDataFrame(b, REQUESTS) for b in batches]
    for i, frame in enumerate(frames):
        registry.register(frame, corpus, i)
    want = registered(batches, held)
    assert rows_of(registry) == want
    for i in (2, 1):
        registry.register(frames[i], corpus, i)
        assert rows_of(registry) == want
    registry.register(frames[0].limit(0), corpus, 3)            # an empty batch
    assert rows_of(SourceRegistry(spark, name, buckets=4)) == want
    again = SourceRegistry(spark, f"{name}_again", scratch_path(spark, name), buckets=4)
    assert rows_of(again) == want                               # another session's catalog finds the partitions


def test_registry_follows_a_restarted_stream(spark):
    tag = uuid.uuid4().hex
    path, corpus = scratch_path(spark, f"in-{tag}"), spark.createDataFrame([("a",), ("b",)], "url string")
    registry = SourceRegistry(spark, f"registry_{tag}", buckets=2)
    batches = [[("r", "b", 0, 5), ("r", "b", 0, 2), ("r", "x", 0, 1)], [("r", "a", 0, 0), ("r", "b", 0, 0), ("q", "b", 1, 1)]]
    for rows in batches:
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(path)
        registry.follow(spark.readStream.schema(REQUESTS).parquet(path), corpus, scratch_path(spark, f"ck-{tag}"))
    assert rows_of(registry) == registered(batches, {"a", "b"})
