"""Line dedup by winnowing over line hashes.

A passage is a run of whole lines with at least ``min_words`` words.  For every
line the shortest such run that starts there is a window, and
the shortest that ends there; the smallest line hash in a window
is its fingerprint, so two documents that share a run of lines with that many
words are sure to share a fingerprint.  Positions are joined on the fingerprints
that occur more than once; at these, equal windows match, and the windows that
match around a position extend the match both ways: every line of a repeated run
lies in a window that starts at it or in the one that ends with the run.  The
first occurrence (by ``doc_id``, then line) of a run stays, later ones are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import materialize

NULL_ID = -(1 << 63)
WINDOWS = "fingerprint long, did long, digest long, windows array<struct<first:int,last:int,content:binary>>"


def windows_of(lines: list[bytes], min_words: int) -> list[tuple[int, int, int, int, bytes]]:
    """(fingerprint, its line, first line, last line, content digest) of every
    window: the shortest run of lines from a non-blank line on with at least
    ``min_words`` words, the shortest up to one, and two
    such lines in a row (for blank lines between them).  Lines are compared with
    white space collapsed."""
    words = [line.split() for line in lines]
    solid = [i for i, w in enumerate(words) if w]
    keys = {i: hashlib.blake2b(b" ".join(words[i]), digest_size=16).digest() for i in solid}
    bounds, right, total = {}, 0, 0
    for left, first in enumerate(solid):
        while right < len(solid) and total < min_words:
            total += len(words[solid[right]])
            right += 1
        if total < min_words:
            break
        bounds[left, right] = None
        total -= len(words[first])
    left, total = 0, 0
    for right, last in enumerate(solid, 1):
        total += len(words[last])
        while total - len(words[solid[left]]) >= min_words:
            total -= len(words[solid[left]])
            left += 1
        if total >= min_words:
            bounds[left, right] = None
        if left == right - 1 > 0 and total >= min_words and len(words[solid[left - 1]]) >= min_words:
            bounds[left - 1, right] = None
    out = []
    for left, right in bounds:
        run = solid[left:right]
        lowest = min(run, key=lambda i: (keys[i], -i))
        content = keys[run[0]] if len(run) == 1 else hashlib.blake2b(b"".join(keys[i] for i in run),
                                                                     digest_size=16).digest()
        out.append((int.from_bytes(keys[lowest][:8], "big", signed=True), lowest, run[0], run[-1], content))
    return out


def _fingerprints(min_words: int):
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out, held = ([], [], [], []), 0
            for did, digest, text in zip(*(batch.column(c) for c in range(3))):
                text = text.as_py()
                if not text:
                    continue
                at = {}
                for mark, line, first, last, content in windows_of(text.encode("utf-8").split(b"\n"), min_words):
                    at.setdefault((mark, line), []).append({"first": first, "last": last, "content": content})
                for (mark, _), found in at.items():
                    for column, value in zip(out, (mark, did.as_py(), digest.as_py(), found)):
                        column.append(value)
                held += len(at)
                if held > 20000:
                    yield _batch(out)
                    out, held = ([], [], [], []), 0
            if held:
                yield _batch(out)

    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("content", pa.binary())]))

    def _batch(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
             pa.array(out[3], kind)], ["fingerprint", "did", "digest", "windows"])
    return emit


def _without(lines, spans):
    """Lines outside the deleted spans (sorted, disjoint (first, last)): the
    slices between them."""
    def between(k):
        start = F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["last"] + 1)
        end = F.coalesce(F.get(spans, k)["first"], F.size(lines))
        return F.slice(lines, start + 1, end - start)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), between))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later repeats of passages deleted from ``text``, plus
    ``n_lines``, ``n_removed`` (long) and ``removed``, the deleted line ranges
    (array of (first, last), merged, lines from 0).

    * A line goes when it lies in any run of at least ``min_words`` words that
      occurred before.
    * Null and empty texts stay as they are (0 and 1 lines); a text with fewer
      than ``min_words`` words has no passage.  Lines end at ``\\n``.
    * Occurrences are ordered by ``doc_id`` (null first), a hash of the text,
      and line; rows equal in ``doc_id`` and text are one document and all get
      its result.
    * Other columns are kept; input columns named like the added ones are
      replaced.  An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    did, digest = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64("text")
    marks = materialize(docs.select(did.alias("did"), digest.alias("digest"), "text")
                        .mapInArrow(_fingerprints(min_words), WINDOWS), "fingerprints")
    shared = marks.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    found = materialize(
        marks.join(materialize(shared, "shared"), "fingerprint", "left_semi")
        .select("did", "digest", F.inline("windows")), "windows")
    place = F.struct("did", "digest", "first")
    origin = materialize(found.groupBy("content").agg(F.min(place).alias("origin"), F.count("*").alias("n"))
                         .where("n > 1").select("content", "origin"), "origins")
    later = (found.join(origin, "content").where(place > F.col("origin"))
             .groupBy("did", "digest").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans")))
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] >= s["first"] - 1),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                       F.array(F.struct(F.get(acc, F.size(acc) - 1)["first"].alias("first"),
                                                        F.greatest(F.get(acc, F.size(acc) - 1)["last"], s["last"]).alias("last")))))
        .otherwise(F.concat(acc, F.array(s))))
    later = later.select(F.col("did").alias("_did"), F.col("digest").alias("_digest"), merged.alias("removed"))
    lines = F.split("text", "\n", -1)
    rows = docs.join(later, (did == F.col("_did")) & (digest == F.col("_digest")), "left")
    removed = F.coalesce("removed", F.array().cast("array<struct<first:int,last:int>>"))
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(
        F.array_join(_without(lines, F.col("removed")), "\n"))
    count = F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    rest = [c for c in docs.columns]
    return rows.select(*(kept.alias("text") if c == "text" else F.col(c) for c in rest),
                       n_lines.cast("long").alias("n_lines"), count.alias("n_removed"), removed.alias("removed"))
