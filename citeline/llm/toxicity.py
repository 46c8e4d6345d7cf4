"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-cased words and their 4, 5 and 6 byte prefixes, hashed into
``2**BITS`` buckets; a document is the set of its terms.  The model is
``w0 + sum w_i + sum_{i<j} <v_i, v_j>``, so pairs of terms (an insult together
with a group) count beyond their separate weights.  It is fitted on a bounded
sample of labelled documents; every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.llm.common import materialize
from citeline.llm.tokens import PIECE, hash_words, text_buffers

BITS = 20
PREFIXES = (4, 5, 6)
#: Bound on the labelled documents that the model is fitted on.
SAMPLE = 10_000
#: Defaults of the bound on the term buckets in the model, and of the least chi-square of each.
TERMS = 4096
CHI_SQUARE = 20.0
FACTORS = 4


def _terms(column: pa.Array, cache: dict):
    """Yield ``(text index, bucket)`` arrays, piece by piece; a text may span
    pieces (cut between words)."""
    data, offsets = text_buffers(column)
    at, end, i = int(offsets[0]), int(offsets[-1]), 0
    while at < end:
        stop = min(at + PIECE, end)
        if stop < end:
            bounds = offsets[(offsets > at) & (offsets <= stop)]
            if len(bounds):
                stop = int(bounds[-1])
            else:  # inside one long text: cut after white space (the tables exist after the first call)
                hash_words(data[at:at + 1], np.zeros(0, np.int64), cache)
                back = np.flatnonzero(cache["gap"][data[at:stop]])
                if len(back):
                    stop = at + int(back[-1]) + 1
                else:
                    more = np.flatnonzero(cache["gap"][data[stop:end]])
                    stop = stop + int(more[0]) + 1 if len(more) else end
        hashes, starts = hash_words(data[at:stop], offsets[(offsets >= at) & (offsets <= stop)] - at, cache,
                                    PREFIXES, alphanumeric=True)
        owner = np.searchsorted(offsets, starts + at, "right") - 1
        yield np.tile(owner, len(hashes)), (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64).ravel()
        at = stop


def _term_sets(batches: Iterator[pa.RecordBatch]):
    cache: dict = {}
    for batch in batches:
        found = [np.unique(owner << BITS | bucket) for owner, bucket in _terms(batch.column("text"), cache)]
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        bounds = np.searchsorted(both >> BITS, np.arange(len(batch) + 1))
        buckets = (both & ((1 << BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("toxic"),
             pa.array([buckets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
            ["place", "toxic", "terms"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]):
    """A task's documents per bucket, and the toxic ones among them."""
    both, hit = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for toxic, terms in zip(batch.column("toxic").to_pylist(), batch.column("terms").to_pylist()):
            buckets = np.frombuffer(terms, np.int32)
            both[buckets] += 1
            hit[buckets] += toxic > 0
    at = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at]), pa.array(hit[at])], ["bucket", "n", "hit"])


def best_buckets(sets: DataFrame, terms: int, chi_square: float) -> np.ndarray:
    """The ``terms`` buckets of ``sets(toxic, terms)`` with the highest chi-square, at
    least ``chi_square`` each, ascending.  Counted and ranked on the executors."""
    size, toxic = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == size:
        return np.zeros(0, np.int64)
    share = toxic / size
    counts = (sets.mapInArrow(_bucket_counts, "bucket long, n long, hit long")
              .groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).where(F.col("n") < size))
    spread = F.col("n") * (1 - F.col("n") / size) * share * (1 - share)
    chi = F.pow(F.col("hit") - F.col("n") * share, F.lit(2)) / spread
    top = (counts.select("bucket", chi.alias("chi")).where(F.col("chi") >= chi_square)
           .orderBy(F.desc("chi"), "bucket").limit(terms).collect())
    return np.sort(np.array([r["bucket"] for r in top], np.int64))


def _known_terms(best: np.ndarray):
    """Replace ``terms`` by the places of those in ``best``."""
    def known(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [np.searchsorted(best, x[np.isin(x, best)]).astype(np.int32).tobytes()
                    for x in (np.frombuffer(t, np.int32) for t in batch.column("terms").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), pa.array(rows, pa.binary())],
                                             ["place", "toxic", "terms"])
    return known


def _activate(w, v, w0, rows, cols, size):
    """Raw scores of ``size`` documents with active terms (rows, cols), and
    the factor sums."""
    sums = np.stack([np.bincount(rows, v[cols, f], size) for f in range(v.shape[1])], 1)
    squares = np.bincount(rows, (v ** 2).sum(1)[cols], size)
    return w0 + np.bincount(rows, w[cols], size) + 0.5 * ((sums ** 2).sum(1) - squares), sums


def fit(best: np.ndarray, terms: list[np.ndarray], toxic: np.ndarray, epochs: int = 250, rate: float = 0.05,
        decay: float = 1e-3, chunk: int = 500) -> dict:
    """Factorization machine on the buckets ``best``; ``terms`` holds each
    document's places in it.  Full-batch Adam on the logistic loss, the gradient summed over
    ``chunk`` documents at a time.  Deterministic."""
    size = len(terms)
    share = float(toxic.mean()) if size else 0.0
    w0 = float(np.clip(np.log((share * size + 0.5) / ((1 - share) * size + 0.5)), -8, 8))
    if not len(best):
        return {"buckets": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, FACTORS)), "w0": w0}
    chunks = []
    for i in range(0, size, chunk):
        part = terms[i:i + chunk]
        chunks.append((np.repeat(np.arange(len(part), dtype=np.int32), [len(t) for t in part]), np.concatenate(part), toxic[i:i + chunk]))
    random = np.random.default_rng(0)
    params = [np.zeros(len(best)), random.normal(0, 0.05, (len(best), FACTORS)), np.array([w0])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        w, v, w0 = params
        grads = [decay / 10 * w / size ** 0.5, decay * v / size ** 0.5, np.zeros(1)]
        for rows, cols, marked in chunks:
            raw, sums = _activate(w, v, w0[0], rows, cols, len(marked))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - marked) / size
            pull = error[rows]
            grads[0] += np.bincount(cols, pull, len(best))
            for f in range(FACTORS):
                grads[1][:, f] += np.bincount(cols, pull * (sums[rows, f] - v[cols, f]), len(best))
            grads[2] += error.sum()
        for p, g, m, s in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return {"buckets": best, "w": params[0], "v": params[1], "w0": float(params[2][0])}


def held_out(doc_id="doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text is
    divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, chi_square: float = CHI_SQUARE) -> dict:
    """Model fitted on at most ``sample`` labelled documents that are not held
    out, taken in hash order of their ids (all of them if there are fewer), on the ``terms``
    term buckets with the highest chi-square (at least ``chi_square`` each).

    A document with several labels counts as toxic if any says so; of several rows with its
    id the smallest text counts; null labels and ids take no part.  Without labels every score is the prior.
    Only the chosen buckets of each sampled document reach the driver.
    """
    marked = (labels.where("doc_id is not null and toxic is not null").where(~held_out())
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    known = docs.select("doc_id").distinct().join(marked, "doc_id")
    chosen = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    once = texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    columns = "place long, toxic int, terms binary"
    sets = materialize(once.select(F.xxhash64("doc_id").alias("place"), "toxic", "text").mapInArrow(_term_sets, columns), "terms")
    best = best_buckets(sets, terms, chi_square)
    got = sorted(sets.mapInArrow(_known_terms(best), columns).toArrow().to_pylist(), key=lambda r: (r["place"], r["terms"]))
    toxic = np.array([r["toxic"] for r in got], float)
    found = [np.frombuffer(r["terms"], np.int32) for r in got]
    return fit(best, found, toxic)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if the score is at
    least 0.5).  Null and wordless texts get the model's base rate; input columns
    of these names are replaced; every row is scored by itself."""
    docs = docs.drop("score", "predicted")

    def scored(batches: Iterator[pa.RecordBatch]):
        cache: dict = {}
        index = np.full(1 << BITS, -1)
        index[model["buckets"]] = np.arange(len(model["buckets"]))
        width = max(1, len(model["buckets"]))
        for batch in batches:
            found = []
            for owner, bucket in _terms(batch.column("text"), cache):
                known = index[bucket]
                active = known >= 0
                found.append(np.unique(owner[active] * width + known[active]))
            both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            raw, _ = _activate(model["w"], model["v"], model["w0"], both // width, both % width, len(batch))
            value = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names)

    names = [*docs.columns, "score", "predicted"]
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, chi_square: float = CHI_SQUARE) -> DataFrame:
    """Train on the labelled rows and score every row of ``docs``; the parameters bound the fitting (see ``train``)."""
    return score(docs, train(docs, labels, sample, terms, chi_square))
