"""Fetch cache over request logs.

S3 — anchored TTL.  A request is a hit when the last successful cache write
for its key is younger than the TTL (strictly); otherwise it is a miss, and
a successful miss writes the cache (resets the anchor).  A hit never extends
the anchor and a failed fetch writes nothing.  Each decision depends on the
previous miss, so the misses of one key form a chain that has to be
followed in time order; ``lag`` or window tricks cannot express it.

Plan: requests are range-partitioned by (key, time), so a busy key spreads
over many partitions however dense its requests are.  Every partition folds
its sorted rows in Arrow batches with one anchor as state, jumping from miss
to miss by binary search.  Only a key that goes on from an earlier
partition may enter with an anchor.  Such a stretch is a function from the
entering anchor to the leaving one; the functions of a key's stretches are
composed pairwise in a tree, the real anchors are passed back down it, and
the stretches concerned are folded again.  What one task gathers is bounded by a
partition and a key's requests within one TTL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.session import written

TTL_HOURS = 6


def fold_key(t: np.ndarray, good: np.ndarray, anchor: int | None, ttl_us: int):
    """Hit flags and anchors for the sorted request times ``t`` of one key,
    starting from ``anchor`` (microseconds, or None); returns the final anchor.
    The loop advances once per miss: a run of hits is skipped by binary search."""
    n = len(t)
    hit = np.zeros(n, dtype=bool)
    anchor_out = np.full(n, NO_ANCHOR, dtype=np.int64)
    a, i = anchor, 0
    while i < n:
        if a is not None and t[i] - a < ttl_us:
            j = int(np.searchsorted(t, a + ttl_us, side="left"))
            hit[i:j] = True
            anchor_out[i:j] = a
            i = j
            continue
        if good[i]:
            a = int(t[i])
        if a is not None:
            anchor_out[i] = a
        i += 1
    return hit, anchor_out, a


NO_ANCHOR = np.iinfo(np.int64).min


def to_micros(s: pd.Series) -> np.ndarray:
    return s.to_numpy().astype("datetime64[us]").astype(np.int64)


def from_micros(a: np.ndarray) -> pd.Series:
    return pd.Series(np.where(a == NO_ANCHOR, np.datetime64("NaT"), a.astype("datetime64[us]")))


def _ttl_batches(batches: Iterator[pd.DataFrame], keys: list[str], ts: str, ok: str, ttl_us: int):
    cur_key, anchor = None, None          # carried across batches of one partition
    for pdf in batches:
        if pdf.empty:
            continue
        cols = [pdf[k].astype(object).where(pdf[k].notna(), None).to_numpy() for k in keys]  # null keys are equal
        t = to_micros(pdf[ts])
        good = pdf[ok].to_numpy().astype(bool)
        hit = np.zeros(len(pdf), dtype=bool)
        anchor_out = np.full(len(pdf), NO_ANCHOR, dtype=np.int64)
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.r_[starts[1:], len(pdf)]
        for s, e in zip(starts, ends):
            group = tuple(c[s] for c in cols)
            a0 = anchor if group == cur_key else None
            hit[s:e], anchor_out[s:e], a = fold_key(t[s:e], good[s:e], a0, ttl_us)
            cur_key, anchor = group, a
        out = pdf.copy()
        out["hit"] = hit
        out["anchor"] = from_micros(anchor_out).to_numpy()
        yield out


def _micros(ts: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


# A stretch as a function: sorted rows (upto, out).  A key whose anchor expires at time e leaves the stretch with the
# ``out`` of the first row with ``upto`` >= e; SAME: with the anchor it came with; NO_ANCHOR: without one.
SAME = np.iinfo(np.int64).max
_TABLE = "key_id long, node long, upto long, out long"


def stretch_table(t: np.ndarray, good: np.ndarray, ttl_us: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The function of one stretch with sorted times ``t``; the ``first`` stretch
    of a key is entered without an anchor only."""
    n = len(t)
    if first:
        out = fold_key(t, good, None, ttl_us)[2]
        return np.array([SAME]), np.array([NO_ANCHOR if out is None else out])
    # the next request that writes from i on, and from there the one after its anchor expires
    success = np.append(np.minimum.accumulate(np.where(good, np.arange(n), n)[::-1])[::-1], n)
    after = np.append(np.searchsorted(t, t + ttl_us, side="left"), n)
    last = success.copy()                       # last write of the chain that starts at i, by pointer doubling
    jump = success[after[np.minimum(success, n)]]
    jump[success == n] = n
    while (jump < n).any():
        last = np.where(jump < n, jump, last)
        last, jump = np.where(jump < n, last[np.minimum(jump, n)], last), np.where(jump < n, jump[np.minimum(jump, n)], n)
    outs = np.append(t, NO_ANCHOR)[last[:n]]
    entered = t[0] + ttl_us                     # an anchor from before the stretch has expired by then
    m = min(n, int(np.searchsorted(t, entered, side="left")) + 1)
    upto, outs = t[:m], outs[:m]
    if t[-1] < entered:                         # it may also outlive the stretch
        upto, outs = np.append(upto, SAME), np.append(outs, SAME)
    ends = np.append(outs[1:] != outs[:-1], True)
    return upto[ends], outs[ends]


def compose(inner: tuple[np.ndarray, np.ndarray], outer: tuple[np.ndarray, np.ndarray], ttl_us: int):
    """The function of a stretch and the one after it."""
    upto, out = inner
    known = out != SAME
    expires = np.where(out == NO_ANCHOR, NO_ANCHOR, np.where(known, out, 0) + ttl_us)
    at = np.minimum(np.searchsorted(outer[0], expires, side="left"), len(outer[0]) - 1)
    mapped = np.where(outer[1][at] == SAME, out, outer[1][at])
    uptos, outs = upto[known], mapped[known]
    if not known.all():                         # what outlives the first stretch enters the second as it is
        uptos, outs = np.append(uptos, outer[0]), np.append(outs, outer[1])
    return uptos, outs


def _entering(spanning: DataFrame, tables: DataFrame, ttl_us: int) -> DataFrame:
    """``(key_id, node, expires)`` per stretch after a key's first: when the anchor
    that it is entered with expires (NO_ANCHOR: none)."""
    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "upto"])
        sides = [(g["upto"].to_numpy(), g["out"].to_numpy()) for _, g in pdf.groupby("node", sort=True)]
        upto, out = sides[0] if len(sides) == 1 else compose(sides[0], sides[1], ttl_us)
        return pd.DataFrame({"key_id": pdf["key_id"].iloc[0], "node": pdf["node"].iloc[0] // 2, "upto": upto, "out": out})

    levels = [tables]
    widest = spanning.agg(F.max("node")).first()[0] + 1
    while widest > 2:
        up = levels[-1].groupBy("key_id", F.floor(F.col("node") / 2).alias("pair")).applyInPandas(pairs, _TABLE)
        levels.append(written(up, "ttl-level"))
        widest = -(-widest // 2)
    state = levels[-1].select("key_id").distinct().select("key_id", F.lit(0).cast("long").alias("node"),
                                                          F.lit(NO_ANCHOR).alias("expires"))
    for depth, level in enumerate(reversed(levels)):
        if depth:  # the root of the tree is its last level's pair; below, nodes double
            state = state.withColumnRenamed("node", "parent")
            nodes = level.select("key_id", "node", F.floor(F.col("node") / 2).alias("parent")).distinct()
            state = nodes.join(state, ["key_id", "parent"]).drop("parent")
        else:
            state = level.select("key_id", "node").distinct().join(state.drop("node"), "key_id")
        known = state.where(F.col("node") % 2 == 0)
        left = (level.join(known, ["key_id", "node"]).where("upto >= expires")
                .groupBy("key_id", "node", "expires").agg(F.min_by("out", "upto").alias("out")))
        leaves = (F.when(F.col("out") == SAME, F.col("expires")).when(F.col("out") == NO_ANCHOR, F.lit(NO_ANCHOR))
                  .otherwise(F.col("out") + ttl_us))
        right = state.where(F.col("node") % 2 == 1).drop("expires").join(
            left.select("key_id", (F.col("node") + 1).alias("node"), leaves.alias("expires")), ["key_id", "node"])
        state = written(known.unionByName(right.select(*known.columns)), "ttl-entering")
    return state.where("node > 0")


def ttl_hits(requests: DataFrame, key: str, ts: str, req_id: str, ok: str | None = None,
             ttl_hours: float = TTL_HOURS, partitions: int | None = None) -> DataFrame:
    """S3: every request with ``hit`` and the ``anchor`` (last write) it saw.

    Requests of a key are taken in order of ``ts``, then ``req_id``; a null key is a key too.
    ``partitions`` sets the number of ranges (default: Spark's, coalesced by AQE)."""
    df = requests if ok else requests.withColumn("_ok", F.lit(True))
    okc = ok or "_ok"
    ttl_us = int(ttl_hours * 3600 * 1_000_000)
    by = [key, ts, req_id]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    ranged = ranged.sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"),
                                                     F.monotonically_increasing_id().alias("_row"))
    schema = T.StructType([*ranged.schema.fields, T.StructField("hit", T.BooleanType()), T.StructField("anchor", df.schema[ts].dataType)])
    rows = written(ranged.mapInPandas(lambda it: _ttl_batches(it, [key], ts, okc, ttl_us), schema), "ttl-stretches")

    # a key lies in several partitions only as their first or last key
    edges = rows.groupBy("_part").agg(F.min_by(F.struct(key), "_row").alias("a"), F.max_by(F.struct(key), "_row").alias("b"))
    edges = edges.select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).select("_part", F.col(f"k.{key}").alias("_key"))
    same = Window.partitionBy("_key")
    spanning = written(edges.select(
        "_part", "_key", F.min("_part").over(same).cast("long").alias("key_id"), F.count(F.lit(1)).over(same).alias("n"),
        (F.row_number().over(same.orderBy("_part")) - 1).cast("long").alias("node")).where("n > 1").drop("n"), "ttl-spanning")
    if spanning.limit(1).count() == 0:
        return _cleared(rows, ok)

    here = F.broadcast(spanning.withColumnRenamed("_part", "_p"))  # two rows a partition at most
    match = (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key"))
    mine = rows.join(here, match).drop("_p", "_key")
    slim = mine.select("key_id", "node", _micros(ts).alias("us"), F.col(okc).alias("ok"), "_row")

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        node = int(pdf["node"].iloc[0])
        upto, out = stretch_table(pdf["us"].to_numpy(), pdf["ok"].to_numpy().astype(bool), ttl_us, node == 0)
        return pd.DataFrame({"key_id": pdf["key_id"].iloc[0], "node": node, "upto": upto, "out": out})

    tables = written(slim.groupBy("key_id", "node").applyInPandas(tabulate, _TABLE), "ttl-tables")
    entering = _entering(spanning, tables, ttl_us)

    def refold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        expires = int(pdf["expires"].iloc[0])
        hit, anchor, _ = fold_key(to_micros(pdf[ts]), pdf[okc].to_numpy().astype(bool),
                                  None if expires == NO_ANCHOR else expires - ttl_us, ttl_us)
        return pdf.drop(columns=["key_id", "node", "expires"]).assign(hit=hit, anchor=from_micros(anchor).to_numpy())

    late = mine.join(entering, ["key_id", "node"])
    again = late.select(*rows.columns, "key_id", "node", "expires").groupBy("key_id", "node").applyInPandas(refold, rows.schema)
    rest = rows.join(here.where("node > 0"), match, "left_anti")
    return _cleared(rest.unionByName(again), ok)


def _cleared(rows: DataFrame, ok: str | None) -> DataFrame:
    return rows.drop("_part", "_row", *([] if ok else ["_ok"]))


def latest_per_key(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write wins per key (partial aggregation; a hot key is
    combined map-side)."""
    rest = [c for c in writes.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return writes.groupBy(key).agg(best.alias("_w")).select(key, *[F.col("_w")[c].alias(c) for c in rest])
