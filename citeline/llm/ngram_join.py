"""N-gram Jaccard join by vertical partitioning.

Every document is its set of word 5-grams.  All sets are sorted by one global
order - rare grams first, from a corpus-wide count sketch - and that order is
cut into fragments.  Documents that share a gram within their prefixes are
candidates; each candidate pair is then counted fragment by fragment on cut-out
segments, and the partial overlaps are summed per pair.

Documents with equal sets are one document to all that follows.  Groups are
never expanded into all pairs.  Within a gram's posting list every
document is first compared with one central document (in whose set the gram
comes earliest: edited copies have private grams before it).  Components of
those links follow; only lists that still hold different components are joined
again, and only for pairs that no earlier count rules out.  The components are
therefore those of *all* links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import components, materialize, small
from citeline.llm.tokens import mix, shingles, words_of_texts

SKETCH_BITS = 20
SKETCH_BLOCKS = 256
FRAGMENTS = 4          # of the rare and of the frequent grams each
RARE = 1 << 58         # grams below are of class 0
FIRST = RARE // FRAGMENTS  # and below this in the first fragment
KEY_ROWS = 100_000     # sides that may be broadcast: several at once stay in the driver's heap; only ids that keep texts in place may be more
LOCAL_HOT = 16         # postings of one gram that a task may pass on per batch


def _sets(batches, n: int):
    """Per piece of a batch: (row index of the first text, texts, sorted
    distinct gram hashes of each text)."""
    cache: dict = {}
    for batch in batches:
        for i, j, words, owner in words_of_texts(batch.column("text"), cache):
            grams, text, _ = shingles(words, owner, n)
            bounds = np.searchsorted(text, np.arange(j - i + 1))
            yield batch, i, [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def gram_classes(docs: DataFrame, n: int = 5, bits: int = SKETCH_BITS) -> np.ndarray:
    """Frequency class (0..31) of each of ``2**bits`` hash buckets of grams.

    Every gram of every document is counted; the result has a fixed size (one
    byte per bucket), whatever the corpus.  Class 0 holds the buckets that do
    not stand out from the mean.  Classes only shape the global order: any
    order gives the same result, a poor one costs time.
    """
    block = (1 << bits) // SKETCH_BLOCKS

    def rows(counts):
        parts = counts.reshape(SKETCH_BLOCKS, block)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SKETCH_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(1 << bits, np.int64)
        pending, held = [], 0
        for _, _, sets in _sets(batches, n):
            pending += sets
            held += sum(map(len, sets))
            if held > 1 << bits:
                counts += np.bincount((np.concatenate(pending) & np.uint64((1 << bits) - 1)).astype(np.int64),
                                      minlength=1 << bits)
                pending, held = [], 0
        if pending:
            counts += np.bincount((np.concatenate(pending) & np.uint64((1 << bits) - 1)).astype(np.int64),
                                  minlength=1 << bits)
        yield rows(counts)

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(value.as_buffer(), np.int64)
                sums[key] = sums[key] + part if key in sums else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         ["block", "counts"])

    schema = "block int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    counts = np.zeros((SKETCH_BLOCKS, block), np.int64)
    for r in parts:
        counts[r["block"]] += np.frombuffer(r["counts"], np.int64)
    mean = counts.mean()
    excess = np.maximum(0.0, counts.reshape(-1) - mean) / (4.0 * np.sqrt(mean) + 4.0)
    return np.minimum(31, np.floor(np.log2(1.0 + excess))).astype(np.uint8)


def _ordered(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Grams as non-negative longs whose numeric order is the global order."""
    kept = grams & np.uint64(RARE - 1)
    cls = classes[(grams & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((cls << np.uint64(58)) | kept).astype(np.int64)


def _fragment(tokens: np.ndarray) -> np.ndarray:
    """Fragment of each ordered gram: pivots cut the rare grams (class 0) and
    the frequent ones into ``FRAGMENTS`` hash ranges each."""
    return np.where(tokens < RARE, 0, FRAGMENTS) + (tokens & (RARE - 1)) // FIRST


def _prefix(size, percent: int):
    """Grams of a set of ``size`` that must meet any partner's prefix."""
    return size - (size * percent + 99) // 100 + 1


POSTINGS = "token long, pn long, doc_id long, hub long, hub_size long"


def _first_of_runs(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _postings(shared, n: int, percent: int):
    """Rows of three kinds: postings (``hub`` null) with ``pn`` = position and
    set size, for the grams of the prefix, of the whole first fragment, and all
    rare ones of a set that consists mainly of frequent ones;
    postings that already have a central document of the same batch as ``hub``
    (only for grams with more than ``LOCAL_HOT`` there: the map-side combine of
    hot grams; their ``hub_size`` is negative); and one row per document (``token`` null, ``pn`` its set size,
    ``hub_size`` its grams in the first fragment, both below 31 bits each of a signature of the set; ``hub``, if all
    its rare grams are posted, their number)."""
    def emit(batches: Iterator[pa.RecordBatch]):
        classes = np.frombuffer(shared.value, np.uint8)

        def flush(ids, sets):
            sizes = np.array([len(s) for s in sets], np.int64)
            sets = [_ordered(s, classes) for s in sets]
            first = np.array([np.searchsorted(s, FIRST) for s in sets], np.int64)
            rare = np.array([np.searchsorted(s, RARE) for s in sets], np.int64)
            posted = np.maximum(first, _prefix(sizes, percent))
            posted = np.where(2 * rare <= sizes, np.maximum(posted, rare), posted)
            sign = mix(np.array([s.astype(np.uint64).sum(dtype=np.uint64) for s in sets], np.uint64))
            high, low = ((sign >> np.uint64(k) & np.uint64((1 << 31) - 1)).astype(np.int64) << 32 for k in (33, 2))
            docs = pa.RecordBatch.from_arrays(
                [pa.nulls(len(ids), pa.int64()), pa.array(high | sizes), ids, pa.array(rare, mask=posted < rare),
                 pa.array(low | first)], names)
            known = np.flatnonzero(np.asarray(ids.is_valid()) & (sizes > 0))
            if not len(known):
                return [docs]
            heads = [sets[k][:posted[k]] for k in known]
            lengths = np.array([len(h) for h in heads])
            token = np.concatenate(heads)
            doc = np.repeat(np.asarray(ids.take(pa.array(known)).to_numpy(zero_copy_only=False), np.int64), lengths)
            size = np.repeat(sizes[known], lengths)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            pn = pos << 32 | size
            order = np.lexsort((doc, pn, token))
            token, doc, pn, size = token[order], doc[order], pn[order], size[order]
            lead = _first_of_runs(token)
            hot = (np.arange(len(token)) - lead) >= LOCAL_HOT
            own = np.unique(lead[hot])          # local hubs: a posting, and a row of their own
            pick = np.concatenate([np.arange(len(token)), own])
            done = np.concatenate([hot, np.ones(len(own), bool)])
            token, pn, doc, hub, hub_size = (x[pick] for x in (token, pn, doc, doc[lead], size[lead]))
            return [docs, pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(pn), pa.array(doc), pa.array(hub, mask=~done),
                 pa.array(-hub_size, mask=~done)], names)]

        names = ["token", "pn", "doc_id", "hub", "hub_size"]
        ids, sets, held, current = [], [], 0, None
        for batch, i, more in _sets(batches, n):
            ids.append(batch.column("doc_id").slice(i, len(more)))
            sets += more
            held += sum(map(len, more))
            if held > 1 << 20:
                yield from flush(pa.concat_arrays(ids), sets)
                ids, sets, held = [], [], 0
        if sets:
            yield from flush(pa.concat_arrays(ids), sets)
    return emit


def _stars():
    """Sorted postings -> live postings: each one of a gram that occurs more
    than once, with the gram's central document as ``hub`` (the hub's own row
    included); rows that carry a hub and document rows pass through.  State: the
    current gram's first row."""
    def star(batches: Iterator[pa.RecordBatch]):
        held = None  # (token, pn, doc) of the first row of the last gram seen, and whether it was emitted
        names = ["token", "pn", "doc_id", "hub", "hub_size"]
        for batch in batches:
            plain = np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(3).is_null())
            if not plain.all():
                yield batch.filter(pa.array(~plain))
            if not plain.any():
                continue
            batch = batch.filter(pa.array(plain))
            token, pn, doc = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            if held is not None:
                token, pn, doc = (np.concatenate([[h], x]) for h, x in zip(held, (token, pn, doc)))
            carried = held is not None
            lead = _first_of_runs(token)
            follower = lead != np.arange(len(token))
            has = np.zeros(len(token), bool)
            has[lead[follower]] = True
            if carried and shown:
                has[0] = False                      # the hub's own row was emitted with an earlier batch
            keep = follower | has
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]) for x in (token, pn, doc, doc[lead], pn[lead] & 0xFFFFFFFF)], names)
            last = lead[-1]
            shown = bool(follower[last + 1:].any()) or (carried and last == 0 and shown)
            held = (token[last], pn[last], doc[last])
    return star


def _segments(shared, n: int):
    """``(doc_id, version, fragment, size, grams)``: the sorted set of each text
    cut at the fragments.  ``version`` tells rows that share an id apart."""
    def emit(batches: Iterator[pa.RecordBatch]):
        classes = np.frombuffer(shared.value, np.uint8)
        for batch, i, sets in _sets(batches, n):
            ids = batch.column("doc_id").to_pylist()[i:i + len(sets)]
            out = [[], [], [], [], []]
            for doc, grams in zip(ids, sets):
                tokens = _ordered(grams, classes)
                part = _fragment(tokens)
                order = np.argsort(part, kind="stable")
                tokens, part = tokens[order], part[order]
                version = int(tokens.sum())
                for segment in np.split(tokens, np.flatnonzero(np.diff(part)) + 1) if len(tokens) else []:
                    for value, x in zip(out, (doc, version, int(_fragment(segment[:1])[0]), len(tokens), segment)):
                        value.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                     pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.int64()))],
                    ["doc_id", "version", "fragment", "size", "grams"])
    return emit


def _need(n1, n2, percent: int):
    """Least overlap of two linked sets of these sizes."""
    return F.ceil(percent / F.lit(100.0 + percent) * (n1 + n2) - F.lit(1e-6))


def _fits(n1, n2, percent: int):
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def _count_pairs(docs: DataFrame, pairs: DataFrame, shared, n: int, percent: int) -> DataFrame:
    """``pairs(a, b)`` -> ``(a, b, parts, linked, versions)``: partial overlaps
    per fragment, and whether their sum makes a link.  ``versions`` is above 1
    where rows with different texts share an id.  Pairs without a common gram
    are left out."""
    pairs = materialize(pairs, "pairs")
    ids = _ends(pairs)
    wanted = docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")  # more ids: the texts stay where they are
    parts = wanted.mapInArrow(_segments(shared, n), "doc_id long, version long, fragment int, size long, grams array<long>")
    keys = small(pairs.select("a", "b"), KEY_ROWS)
    side = {s: parts.select(F.col("doc_id").alias(s), F.col("version").alias(f"version_{s}"), "fragment",
                            F.col("size").alias(f"size_{s}"), F.col("grams").alias(f"grams_{s}")) for s in "ab"}
    hubs = side["a"].join(small(materialize(pairs.select("a").distinct(), "hubs"), KEY_ROWS), "a", "left_semi")
    both = side["b"].join(keys, "b").join(hubs, ["a", "fragment"])
    key = ["a", "b", "version_a", "version_b", "size_a", "size_b"]
    partial = (both.select(*key, "fragment", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
               .groupBy(*key, "fragment").agg(F.max("common").alias("common")))  # repeated rows count once
    parts = F.array(*(F.coalesce(F.sum(F.when(F.col("fragment") == f, F.col("common"))), F.lit(0)) for f in range(2 * FRAGMENTS)))
    counted = partial.groupBy(*key).agg(F.sum("common").alias("overlap"), parts.alias("parts"))
    linked = 100 * F.col("overlap") >= percent * (F.col("size_a") + F.col("size_b") - F.col("overlap"))
    return materialize(counted.groupBy("a", "b").agg(F.max("parts").alias("parts"), F.max(linked).alias("linked"),
                                                     F.count("*").alias("versions")), "overlaps")


def _ends(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")


def _copies(live: DataFrame) -> DataFrame:
    """``(doc_id, copy_of)``: documents whose set equals that of a smaller id,
    the smallest one.  Ids that stand for different sets have no copies."""
    one = (live.where("token is null and doc_id is not null").where(F.col("pn").bitwiseAND(0xFFFFFFFF) > 0)
           .groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("pn", "hub_size") for f in (F.min, F.max)))
           .where("min_pn = max_pn and min_hub_size = max_hub_size").drop("max_pn", "max_hub_size"))
    groups = materialize(one.groupBy("min_pn", "min_hub_size").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("k"))
                         .where("k > 1").drop("k"), "copy-groups")
    return materialize(one.join(small(groups, KEY_ROWS), ["min_pn", "min_hub_size"]).where("doc_id <> copy_of")
                       .select("doc_id", "copy_of"), "copies")


def _representatives(live: DataFrame, copies: DataFrame) -> DataFrame:
    """The postings ``(token, pn, doc_id, hub, shared)`` of all but copies, with
    hubs that are no copies (equal sets have equal postings).  ``shared`` tells
    corpus-wide hubs from those of a batch."""
    copies = small(copies, KEY_ROWS)
    hubs = copies.select(F.col("doc_id").alias("hub"), "copy_of")
    rows = live.where("token is not null").join(copies, "doc_id", "left_anti").join(hubs, "hub", "left")
    return materialize(rows.select("token", "pn", "doc_id", F.coalesce("copy_of", "hub").alias("hub"),
                                   (F.col("hub_size") > 0).alias("shared")), "representatives")


def _usable(live: DataFrame, stars: DataFrame) -> DataFrame:
    """``(doc_id, n, usable, usable_rare, rest)``: bounds on what a set of ``n`` grams
    can have in common with another.  The first fragment is posted in full, so
    its grams without a live posting occur nowhere else.  Where all rare grams of
    both sets are posted, that holds for all of them (``usable_rare``, else null).
    ``rest`` is the number of grams outside the first fragment."""
    n = F.col("pn").bitwiseAND(0xFFFFFFFF).alias("n")
    counts = (stars.select("doc_id", n, "token").groupBy("doc_id", "n")
              .agg(F.count(F.when(F.col("token") < FIRST, 1)).alias("live_first"),
                   F.count(F.when(F.col("token") < RARE, 1)).alias("live_rare")))
    sizes = (live.where("token is null").groupBy("doc_id", n)
             .agg(F.min(F.col("hub_size").bitwiseAND(0xFFFFFFFF)).alias("first"), F.min("hub").alias("rare"),
                  (F.count("hub") == F.count("*")).alias("full")))
    bound = lambda posted, found: F.least("n", F.col("n") - F.col(posted) + F.col(found))
    return counts.join(sizes, ["doc_id", "n"]).select(
        "doc_id", "n", bound("first", "live_first").alias("usable"),
        F.when(F.col("full"), bound("rare", "live_rare")).alias("usable_rare"), (F.col("n") - F.col("first")).alias("rest"))


def _most_common(x: dict, y: dict):
    """Bound on the overlap of two sets from their usable sizes."""
    either = F.least(x["usable"], y["usable"])
    rare = F.least(x["usable_rare"], y["usable_rare"])
    return F.when(x["usable_rare"].isNull() | y["usable_rare"].isNull(), either).otherwise(F.least(either, rare))


def _in_prefix(percent: int):
    """Postings beyond the prefix only count as live; they make no candidates."""
    n = F.col("pn").bitwiseAND(0xFFFFFFFF)
    return F.shiftright("pn", 32) < n - F.ceil(n * percent / 100 - F.lit(1e-6)) + 1


def _possible(pairs: DataFrame, usable: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(hub, doc_id, n)`` that can be linked at all, as ``(a, b)``."""
    of_hub = usable.drop("rest").toDF("hub", "hub_size", "hub_usable", "hub_usable_rare")
    bound = _most_common({c: F.col(c) for c in ("usable", "usable_rare")},
                         {c: F.col(f"hub_{c}") for c in ("usable", "usable_rare")})
    return (pairs.join(usable, ["doc_id", "n"]).join(of_hub, "hub")
            .where(_fits(F.col("n"), F.col("hub_size"), percent) & (bound >= _need(F.col("n"), F.col("hub_size"), percent)))
            .select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())


def _first_fragment(pairs: DataFrame, stars: DataFrame, usable: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` that can be linked by their overlap in the first
    fragment.  Its shared grams are all posted, so no text is read for it.  For
    ids with several texts the bounds hold for each of them."""
    pairs = materialize(pairs, "candidates")
    ids = small(_ends(pairs), KEY_ROWS)
    tokens = materialize(stars.where(F.col("token") < FIRST).groupBy("doc_id").agg(F.collect_set("token").alias("tokens")),
                         "first-grams").join(ids, "doc_id", "left_semi")
    sets = (usable.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("n").alias("n"), F.max("rest").alias("rest"))
            .join(tokens, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<long>"))))
    a, b = (sets.toDF(*(f"{c}_{s}" if c != "doc_id" else s for c in sets.columns)) for s in "ab")
    most = F.size(F.array_intersect("tokens_a", "tokens_b")) + F.least("rest_a", "rest_b")
    return (b.join(small(pairs, KEY_ROWS), "b").join(a, "a")
            .where(most >= _need(F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))


def _first_pairs(stars: DataFrame, usable: DataFrame, percent: int) -> DataFrame:
    """(hub, document) pairs of the prefix postings that can be linked."""
    rows = stars.where("hub <> doc_id").where(_in_prefix(percent))
    pairs = rows.select("hub", "doc_id", F.col("pn").bitwiseAND(0xFFFFFFFF).alias("n")).distinct()
    return _possible(pairs, usable, percent)


def _open_postings(stars: DataFrame, usable: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Prefix postings of the grams whose documents are not all linked to their
    hubs, each with the gram's one corpus-wide ``hub``.  (Lists of two have been
    counted; lists linked throughout are one component.)"""
    stars = stars.where(_in_prefix(percent))
    rows = stars.where("hub <> doc_id").select("token", "doc_id", "hub").join(
        small(tested.where("linked").select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), F.lit(True).alias("linked")), KEY_ROWS),
        ["hub", "doc_id"], "left")
    grams = (rows.groupBy("token").agg(F.count("*").alias("others"), F.count("linked").alias("linked"))
             .where("others > 1 and linked < others").select("token"))
    posting = stars.join(small(materialize(grams, "grams"), KEY_ROWS), "token", "left_semi")
    center = posting.groupBy("token").agg(F.max(F.when(F.col("shared"), F.col("hub"))).alias("shared"),
                                          F.min("hub").alias("local"))
    full = usable.groupBy(F.col("doc_id").alias("hub")).agg(F.min(F.col("usable_rare").isNotNull()).alias("hub_full"))
    size = F.col("pn").bitwiseAND(0xFFFFFFFF)
    return materialize(
        posting.drop("shared").join(center, "token")
        .select("token", "doc_id", size.alias("n"), F.shiftright("pn", 32).alias("pos"), F.coalesce("shared", "local").alias("hub"))
        .distinct().join(usable.drop("rest"), ["doc_id", "n"]).join(full, "hub", "left"), "postings")


def _missed_pairs(posting: DataFrame, tested: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a prefix gram, were not counted
    yet, and can be linked: with ``u`` the usable size and ``h`` a hub that both
    were counted against, their overlap within ``h`` is at most the sum over the
    fragments of ``min(|x & h|, |y & h|)``, and outside ``h`` at most
    ``min(u_x - |x & h|, u_y - |y & h|)``.

    A pair needs to be found at its first common gram only, so nothing before
    that one's position is common; and of grams with the same posting list one
    is enough."""
    near = small(components(links), KEY_ROWS)
    known = small(tested.where("versions = 1").select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), "parts"), KEY_ROWS)
    posting = (posting.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(known, ["hub", "doc_id"], "left")
               .select("token", "doc_id", "n", "pos", "usable", "usable_rare", "hub", F.coalesce("hub_full", F.lit(False)).alias("hub_full"),
                       F.coalesce("component_id", "doc_id").alias("c"), (F.col("hub") == F.col("doc_id")).alias("is_hub"), "parts",
                       F.when(F.col("hub") == F.col("doc_id"), F.col("n"))
                       .otherwise(F.aggregate("parts", F.lit(0).cast("long"), lambda s, v: s + v)).alias("o")))
    posting = materialize(posting, "with-components")
    mixed = (posting.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least"))
             .where("low < high").select("token", "least"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100 - F.lit(1e-6)))
    mixed = small(materialize(mixed, "mixed-grams"), KEY_ROWS)
    posting = materialize(posting.join(mixed, "token").where(
        F.least(F.col("usable"), F.col("n") - F.col("pos")) >= _need(F.col("n"), partner, percent)).drop("least"), "mixed")
    listed = posting.select("token", F.xxhash64("doc_id", "n").alias("entry")).distinct()
    lists = listed.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor("entry").alias("first"),
                                        F.bit_xor(F.xxhash64("entry")).alias("second"))
    kept = lists.where("k > 1").groupBy("k", "first", "second").agg(F.min("token").alias("token")).select("token")
    posting = posting.join(small(materialize(kept, "lists"), KEY_ROWS), "token", "left_semi")
    x, y = ({c: F.col(f"{s}.{c}") for c in posting.columns} for s in "xy")
    need = _need(x["n"], y["n"], percent)
    ahead = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    outside = [F.least(x[u] - x["o"], y[u] - y["o"]) for u in ("usable", "usable_rare")]
    out = F.when(x["hub_full"] & y["hub_full"] & x["usable_rare"].isNotNull() & y["usable_rare"].isNotNull(),
                 F.least(*outside)).otherwise(outside[0])
    within = sum((F.least(F.get(x["parts"], F.lit(f)), F.get(y["parts"], F.lit(f))) for f in range(1, 2 * FRAGMENTS)),
                 F.least(F.get(x["parts"], F.lit(0)), F.get(y["parts"], F.lit(0))))
    by_hub = (F.least(x["o"], y["o"]) + out >= need) & (x["is_hub"] | y["is_hub"] | (within + out >= need))
    possible = (ahead >= need) & (_most_common(x, y) >= need) & (x["o"].isNull() | y["o"].isNull() | by_hub)
    pairs = (posting.alias("x").join(
        posting.alias("y"),
        (x["token"] == y["token"]) & (x["c"] < y["c"]) & _fits(x["n"], y["n"], percent) & possible)
        .select(F.least(x["doc_id"], y["doc_id"]).alias("a"), F.greatest(x["doc_id"], y["doc_id"]).alias("b")).distinct())
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)`` under word-``n``-gram
    Jaccard similarity of at least ``percent`` / 100.

    Returns ``(doc_id, n_shingles, component_id)``, one row per input row.

    * Words: runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; a text
      with fewer than ``n`` words is one gram; null and blank texts have none
      and link with nothing (their component is their own id).
    * Rows repeating a ``doc_id`` are one node; each row is returned.  A null
      ``doc_id`` links with nothing and has a null component.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gram_classes(docs, n).tobytes())
    postings = docs.mapInArrow(_postings(shared, n, percent), POSTINGS)
    spread = F.when(F.col("token").isNotNull() & F.col("hub").isNull(), F.col("token")).otherwise(
        F.xxhash64("doc_id", "token", F.lit(1)))
    live = materialize(postings.repartition(spread).sortWithinPartitions("token", "pn", "doc_id")
                       .mapInArrow(_stars(), POSTINGS), "live")
    copies = _copies(live)
    stars = _representatives(live, copies)
    usable = small(materialize(_usable(live, stars), "usable"), KEY_ROWS)
    tested = _count_pairs(docs, _first_pairs(stars, usable, percent), shared, n, percent)
    posting = _open_postings(stars, usable, tested, percent)
    uncounted = materialize(_possible(posting.where("hub <> doc_id").select("hub", "doc_id", "n").distinct(), usable, percent)
                            .join(tested.select("a", "b"), ["a", "b"], "left_anti"), "uncounted")
    if not uncounted.isEmpty():
        tested = materialize(tested.union(_count_pairs(docs, uncounted, shared, n, percent)), "overlaps")
    links = tested.where("linked").select("a", "b")
    missed = _first_fragment(_missed_pairs(posting, tested, links, percent), stars, usable, percent)
    more = _count_pairs(docs, missed, shared, n, percent)
    comps = components(links.union(more.where("linked").select("a", "b")))
    of_copies = (copies.join(comps.withColumnRenamed("node", "copy_of"), "copy_of", "left")
                 .select(F.col("doc_id").alias("node"), F.coalesce("component_id", "copy_of").alias("component_id")))
    comps = comps.union(of_copies)
    rows = live.where("token is null").select("doc_id", F.col("pn").bitwiseAND(0xFFFFFFFF).alias("n_shingles"))
    return (rows.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
