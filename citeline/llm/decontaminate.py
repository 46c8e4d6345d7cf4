"""Benchmark decontamination by size-partitioned MinHash containment search,
in DataFrame functions only.

A test item leaks into a document when at least 75 % of its word 5-grams occur
there.  A document's grams that occur in no item cannot count, so each document
is first reduced to its grams that some item has.  What remains is partitioned
by size; within a partition the containment threshold becomes a Jaccard
threshold (from the partition's upper size and the item's size), and enough
min-hashes are compared that a leak escapes with probability below
``MISS``.  Where that would take more than ``MAX_HASHES`` min-hashes, the grams
themselves are compared instead, which misses nothing.  Candidates are verified
by exact containment.  An item of fewer than 5 words is one gram of its words; documents
are cut into grams of that length too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import materialize, small

MISS = 1e-9
MAX_HASHES = 128
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters;
    null and wordless texts give an empty array."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    spaced = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def gram_hashes(tokens: Column, n: int = 5) -> Column:
    """Hashes of the word ``n``-grams; none of fewer words."""
    starts = F.sequence(F.lit(0), F.size(tokens) - F.lit(n))
    grams = F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + F.lit(k)) for k in range(n))))
    return F.when(F.size(tokens) < n, F.array().cast("array<long>")).otherwise(grams)


def _band(size: Column) -> Column:
    """Size partition: floor(log2(size))."""
    return F.length(F.bin(size)) - 1


def leaks(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Leaked test items: ``docs(doc_id, text)`` x ``items(item_id, text)`` ->
    ``(doc_id, item_id, n_item, n_shared, containment)``, one row per document
    and item of which the document holds at least ``percent`` % of the grams.

    * Null and wordless texts hold nothing and match nothing; an item with fewer
      than ``n`` words leaks into every document that holds these words in a row.
    * Rows that share a ``doc_id`` (null included) count as one document, rows
      that share an ``item_id`` as one item; an empty side gives no rows.
    * Extra columns are ignored.
    """
    cut = materialize(items.select("item_id", words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0), "item-words")
    short = cut.select(F.size("tokens").alias("m")).where(F.col("m") < n).distinct()
    lengths = [*sorted(r.m for r in short.collect()), n]  # at most ``n`` numbers
    whole = F.when(F.size("tokens") < n, F.array().cast("array<long>")).otherwise(gram_hashes(F.col("tokens"), n))
    for m in lengths[:-1]:
        whole = F.when(F.size("tokens") == m, gram_hashes(F.col("tokens"), m)).otherwise(whole)
    item_grams = materialize(cut.select("item_id", F.explode(whole).alias("gram")).distinct(), "item-grams")
    known = materialize(item_grams.select("gram").distinct(), "known-grams")
    tokens = docs.select("doc_id", words(F.col("text")).alias("tokens"))
    all_lengths = F.concat(*(gram_hashes(F.col("tokens"), m) for m in lengths))
    grams = tokens.select("doc_id", F.explode(all_lengths).alias("gram"))
    hits = grams.join(small(known), "gram").groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    hits = materialize(hits.select("doc_id", "grams", _band(F.size("grams")).alias("part")), "hits")

    sets = item_grams.groupBy("item_id").agg(F.collect_set("gram").alias("item_grams"))
    sets = sets.withColumn("band", _band(F.size("item_grams")))
    upper = F.pow(F.lit(2.0), F.col("part") + 1) - 1
    jaccard = (percent / 100.0) / (upper / F.col("least") + 1 - percent / 100.0)
    hashes = F.least(F.ceil(F.lit(math.log(MISS)) / F.log(1 - F.least(jaccard, F.lit(0.999)))), F.lit(MAX_HASHES + 1))
    plan = materialize(
        sets.groupBy("band").agg(F.min(F.size("item_grams")).alias("least"))
        .select("band", "least", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("part"))
        .where(upper * 100 >= F.col("least") * percent)
        .select("band", "part", hashes.cast("int").alias("hashes"), (hashes > MAX_HASHES).alias("plain")), "plan")

    def minhashes(grams_col: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.col("hashes") - 1),
            lambda k: F.struct(k.alias("k"), F.array_min(F.transform(grams_col, lambda g: F.xxhash64(g, k))).alias("v")))

    def signature(rows: DataFrame, grams_col: str, *ids: str) -> DataFrame:
        """``(ids, part, k, v)``: rows with their number of ``hashes`` as
        min-hashes, rows marked ``plain`` as grams (k = -1)."""
        by_hash = rows.where("hashes > 0").select(*ids, "part", F.inline(minhashes(grams_col)))
        by_gram = rows.where("plain").select(*ids, "part", F.lit(-1).alias("k"), F.explode(grams_col).alias("v"))
        return by_hash.union(by_gram)

    for_docs = plan.groupBy("part").agg(
        F.coalesce(F.max(F.when(~F.col("plain"), F.col("hashes"))), F.lit(0)).alias("hashes"),
        F.max("plain").alias("plain"))
    for_items = plan.withColumn("hashes", F.when(F.col("plain"), 0).otherwise(F.col("hashes")))
    left = signature(hits.join(for_docs, "part"), "grams", "doc_id")
    right = signature(sets.join(for_items, "band"), "item_grams", "item_id")
    found = left.join(right, ["part", "k", "v"]).select("doc_id", "item_id").distinct()
    shared = F.size(F.array_intersect("grams", "item_grams"))
    return (found.withColumnRenamed("doc_id", "found_id").join(hits, F.col("found_id").eqNullSafe(F.col("doc_id")))
            .join(sets, "item_id")
            .select("doc_id", "item_id", F.size("item_grams").cast("long").alias("n_item"),
                    shared.cast("long").alias("n_shared"))
            .where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
            .withColumn("containment", F.col("n_shared") / F.col("n_item")))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leaked item."""
    found = leaks(docs, items).select("doc_id").distinct()
    found = materialize(found, "leaked").withColumnRenamed("doc_id", "leaked_id")
    return docs.join(small(found), docs["doc_id"].eqNullSafe(F.col("leaked_id")), "left_anti")
