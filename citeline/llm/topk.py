"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are cut into blocks; every (query block, candidate
block) pair is scored as one small matrix product.  Scores are never stored:
each round, every pair counts its scores into a histogram of the query's
current interval (only the bins that can still hold the k-th value), the counts
are summed per query, and the interval shrinks to the one bin that holds the
k-th value.  When the interval is a single integer, scores at or above it are
kept, ties going to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeline.llm.common import materialize

BINS = 2048
QUERY_BLOCK = 2048       # queries and candidates in one block, on average
CANDIDATE_BLOCK = 8192
PIECE = 512              # queries scored at once


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors count as padded with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, query by candidate; through float64 where that
    is exact."""
    top = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    if top < 2 ** 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _pieces(candidates: pd.DataFrame, queries: pd.DataFrame):
    """(queries, candidate ids, scores with the query's own row marked)."""
    width = max([0, *map(len, candidates["v"]), *map(len, queries["query"])])
    c = _matrix(candidates["v"].to_numpy(), width)
    ids = candidates["vec_id"].to_numpy(np.int64)
    for at in range(0, len(queries), PIECE):
        part = queries.iloc[at:at + PIECE]
        scores = _scores(c, _matrix(part["query"].to_numpy(), width))
        yield part, ids, scores, ids[None, :] == part["query_id"].to_numpy(np.int64)[:, None]


def _histograms(bins: int):
    def count(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            for part, _, scores, own in _pieces(candidates, queries):
                for q, low, width, need, row, self_row in zip(
                        part["query_id"], part["low"], part["width"], part["need"], scores, own):
                    row = row[~self_row]
                    row = row[(row >= low) & (row - low < width)]
                    if len(row) > need:  # below this block's own need-th value nothing can matter
                        row = np.partition(row, len(row) - need)[len(row) - need:]
                    found, n = np.unique((row - low) // -(-width // bins), return_counts=True)
                    out.append(pd.DataFrame({"query_id": q, "bin": found, "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "bin": [], "n": []}, dtype="int64")
    return count


def _winners(k: int):
    def keep(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            for part, ids, scores, own in _pieces(candidates, queries):
                for q, low, row, self_row in zip(part["query_id"], part["low"], scores, own):
                    at = np.flatnonzero((row >= low) & ~self_row)
                    at = at[np.lexsort((ids[at], -row[at]))][:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at], "score": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    return keep


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """The ``k`` highest inner products of each query among all other rows of
    ``vectors(vec_id, embedding)``: ``(query_id, rank, vec_id, score)``.

    Components count as ``floor(scale * x)``.  Queries are the rows whose
    ``vec_id`` is divisible by ``every``.  Ties go to the smaller ``vec_id``; with
    fewer than ``k`` candidates all are returned.  Rows with a null ``vec_id``, a
    null vector or a null or non-finite component take no part; of rows that
    repeat a ``vec_id`` the smallest vector counts; shorter vectors count as
    padded with zeros.  Products must fit a long.  Extra columns are ignored.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = materialize(
        vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    total, queries_total, largest = rows.agg(
        F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    limit = min(int(largest * (1 + 1e-9)) + 1, (1 << 62) - 1)  # no product is larger (Cauchy-Schwarz)
    query_blocks = max(1, math.ceil(queries_total / QUERY_BLOCK))
    stripes = max(1, math.ceil(total / CANDIDATE_BLOCK))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = (rows.select("vec_id", "v", block(stripes, 1).alias("stripe"), every_of(query_blocks).alias("block"))
                  .groupBy("block", "stripe"))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), block(query_blocks, 2).alias("block"),
                                          every_of(stripes).alias("stripe"))
    state = rows.where(is_query).select(
        F.col("vec_id").alias("query_id"), F.lit(-limit).cast("long").alias("low"),
        F.lit(2 * limit + 1).cast("long").alias("width"), F.lit(min(k, max(0, total - 1))).cast("long").alias("need"))
    state = materialize(state.where("need > 0"), "intervals")
    width = 2 * limit + 1
    while width > 1 and total > 1:
        counts = candidates.cogroup(queries.join(state, "query_id").groupBy("block", "stripe")).applyInPandas(
            _histograms(BINS), "query_id long, bin long, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        width = -(-width // BINS)
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin"))) - F.col("n")
        hit = (counts.withColumn("above", above).join(state, "query_id")
               .where("above < need and above + n >= need"))
        state = materialize(hit.select("query_id", (F.col("low") + F.col("bin") * width).alias("low"),
                                       F.lit(width).cast("long").alias("width"),
                                       (F.col("need") - F.col("above")).alias("need")), "intervals")
    best = candidates.cogroup(queries.join(state, "query_id").groupBy("block", "stripe")).applyInPandas(
        _winners(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
