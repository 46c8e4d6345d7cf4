"""Prefix trie of conversations in balanced parentheses.

Every distinct sequence of first turns is a node; conversations that begin
with it are its members.  Nodes are counted by the digest of their sequence
(partial aggregates, so a first turn that everybody shares is no hot task).  A
node with one member starts a chain without branches and needs no tree.  The
nodes with more members do: the paths to the deepest of them are range-partitioned in
lexical order, so each shard is one stretch of the depth-first walk.  A shard
writes its stretch as balanced parentheses, finds the end of every subtree by
``findclose`` over range-minimum blocks of the excess, counts its leaves as
``()`` pairs by rank, and reads the savings off cumulative arrays.  The spine that
neighbouring shards share is merged by summing: each node's own weight lies in one
shard only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import materialize
from citeline.operators.running import numbered, running_totals

#: Positions of an excess block, and the nodes after which a shard is closed and a new one begun.
BLOCK, SHARD_NODES = 64, 1 << 20


# --- balanced parentheses -------------------------------------------------------------------------------------------

class Parentheses:
    """A balanced sequence (True opens, False closes) with ``findclose`` and rank."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        size = -(-max(1, len(opens)) // BLOCK)
        levels = 1 << (size - 1).bit_length()
        excess = np.full(levels * BLOCK, np.iinfo(np.int64).max // 2)
        excess[:len(opens)] = np.cumsum(np.where(opens, 1, -1))
        self.excess = excess.reshape(levels, BLOCK)
        lows = self.excess.min(1)
        self.tree = np.concatenate([np.zeros(levels, np.int64), lows])  # node i covers its children 2i and 2i + 1
        for i in range(levels.bit_length() - 2, -1, -1):
            a = 1 << i
            self.tree[a:2 * a] = self.tree[2 * a:4 * a].reshape(a, 2).min(1)
        self.levels = levels
        pairs = np.zeros(len(opens) + 1, np.int64)
        pairs[1:-1] = np.cumsum(opens[:-1] & ~opens[1:]) if len(opens) else 0
        if len(opens):
            pairs[-1] = pairs[-2]
        self.pairs = pairs            # "()" pairs that begin before a position
        self.rank = np.append(0, np.cumsum(opens))  # opening ones before a position

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Closing position of the pairs opened at ``at``, all at once: the first
        later position whose excess is one lower."""
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 14):
            out[i:i + (1 << 14)] = self._close(at[i:i + (1 << 14)])
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        block, spot = at // BLOCK, at % BLOCK
        low = self.excess[block, spot] - 1
        later = np.arange(BLOCK) > spot[:, None]
        here = (self.excess[block] <= low[:, None]) & later
        found = here.any(1)
        node = block + self.levels
        up = ~found
        while up.any():  # climb until a right sibling dips low enough
            right = up & (node % 2 == 0)
            hit = right.copy()
            hit[right] = self.tree[node[right] + 1] <= low[right]
            node = np.where(hit, node + 1, np.where(up, node // 2, node))
            up &= ~hit
        down = ~found & (node < self.levels)
        while down.any():  # descend to the leftmost block that does
            left = np.where(down, 2 * node, node)
            node = np.where(down, np.where(self.tree[left] <= low, left, left + 1), node)
            down = ~found & (node < self.levels)
        there = self.excess[node - self.levels] <= low[:, None]
        return np.where(found, block * BLOCK + here.argmax(1), (node - self.levels) * BLOCK + there.argmax(1))

    def subtrees(self, saved: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node in opening order: the leaves of its subtree (``()`` pairs plus
        the ``extra`` of its nodes) and the sum of ``saved`` over it."""
        at = np.flatnonzero(self.opens)
        close = self.findclose(at)
        last = self.rank[close]
        leaves = self.pairs[close] - self.pairs[at]
        first = np.arange(len(at))
        sums = [np.append(0, np.cumsum(x)) for x in (extra, saved)]
        return leaves + sums[0][last] - sums[0][first], sums[1][last] - sums[1][first]


def shard(paths: Iterator[tuple]) -> Iterator[tuple]:
    """``(nodes, saved, extra)`` paths in lexical order -> ``(nodes, leaves,
    savings)`` arrays of one stretch of the walk after another.

    A path carries the weights of the nodes that it alone accounts for (else 0); they are added to the open node."""
    opens: list[bool] = []
    nodes: list = []
    saved: list[int] = []
    extra: list[int] = []
    stack: list[tuple] = []  # (node, its index) of the open path

    def finish():
        opens.extend([False] * len(stack))
        leaves, savings = Parentheses(np.array(opens, bool)).subtrees(np.array(saved, np.int64), np.array(extra, np.int64))
        return list(nodes), leaves, savings

    for path, path_saved, path_extra in paths:
        same = 0
        while same < len(stack) and same < len(path) and stack[same][0] == path[same]:
            same += 1
        if len(nodes) >= SHARD_NODES:
            yield finish()
            opens, nodes, saved, extra, stack, same = [], [], [], [], [], 0
        opens += [False] * (len(stack) - same) + [True] * (len(path) - same)
        del stack[same:]
        for node in path[same:]:
            stack.append((node, len(nodes)))
            nodes.append(node)
            saved.append(0)
            extra.append(0)
        for (_, i), s, x in zip(stack, path_saved, path_extra):
            saved[i] += s
            extra[i] += x
    if nodes:
        yield finish()


# --- nodes ----------------------------------------------------------------------------------------------------------

def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, k1, k2, n_bytes)``: digests of all turns with their place
    (from 0) in the conversation; ties in ``turn`` go by digest.  Texts do not travel."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    keys = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), *text).alias("k1"), F.xxhash64(F.lit(2), *reversed(text)).alias("k2"),
        F.octet_length(text[1]).cast("long").alias("n_bytes"))
    order = [F.col("turn").asc_nulls_first(), "k1", "k2"]
    return (numbered(materialize(keys, "turns"), ["conv_id"], order, "pos")
            .select("conv_id", (F.col("pos") - 1).alias("pos"), "k1", "k2", "n_bytes"))


def shared_heads(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """``numbered_turns`` rows of the rebuilt conversations: the first ``h`` turns
    come from conversation ``conv_id - conv_id % group`` (all if it has fewer, none
    if absent); ``h`` is the CRC-32 of the decimal id modulo ``heads``.  A head
    conversation has ``group`` takers at most, ``heads - 1`` turns each."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(group))
    ids = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    first = (turns.where(F.col("pos") < heads - 1).where(F.col("conv_id") == base).withColumnRenamed("conv_id", "base"))
    head = materialize(ids.join(first, "base").where("pos < h").select(*turns.columns), "heads")
    taken = head.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    own = turns.where(F.col("pos") >= h).join(taken, "conv_id", "left")
    return head.unionByName(own.withColumn("pos", F.col("pos") - h + F.coalesce("taken", F.lit(0))).drop("taken"))


def _digest(depth, halves) -> list:
    """Two 64-bit digests of a turn sequence from its length and sums."""
    return [F.xxhash64(depth, *halves), F.xxhash64(*reversed(halves), depth)]


def passages(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``(conv_id, depth, h1, h2, p1, p2, n_bytes)``: a row for every node that a
    conversation of ``ids`` passes, the root included, with the digests of its and its parent's turn sequence.

    A sequence is known by its length and the sums of its turns' digests, salted by
    their places; the sums are running totals, so a long conversation spreads
    over many tasks."""
    low = F.lit(0xFFFFFFFF)
    place = F.col("pos")
    salted = [F.xxhash64(place, "k1", "k2"), F.xxhash64("k2", "k1", place)]
    halves = {f"s{i}": x for i, x in enumerate(y for s in salted for y in (s.bitwiseAND(low), F.shiftrightunsigned(s, 32)))}
    cells = turns.select("conv_id", "pos", "n_bytes", *[x.alias(f"a{n}") for n, x in halves.items()])
    sums = running_totals(cells, ["conv_id"], ["pos"], {n: f"a{n}" for n in halves})
    depth, none = F.col("pos") + 1, F.lit(0).cast("long")
    now = _digest(depth, [F.col(n) for n in halves])
    before = _digest(F.col("pos"), [F.col(n) - F.col(f"a{n}") for n in halves])
    top = _digest(none, [none] * len(halves))
    null = F.lit(None).cast("long")
    return (sums.select("conv_id", depth.alias("depth"), now[0].alias("h1"), now[1].alias("h2"),
                        before[0].alias("p1"), before[1].alias("p2"), "n_bytes")
            .unionByName(ids.select("conv_id", none.alias("depth"), top[0].alias("h1"), top[1].alias("h2"),
                                    null.alias("p1"), null.alias("p2"), none.alias("n_bytes"))))


def trie_nodes(steps: DataFrame) -> DataFrame:
    """Nodes from ``passages``: digests, ``conv_id`` (smallest member), ``depth``, ``n_convs``,
    ``n_children``, ``n_tails`` (children with one member) and ``saved`` (the node's own tokens)."""
    nodes = materialize(steps.groupBy("h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "p1", "p2", "n_bytes")]), "nodes")
    children = (nodes.where("p1 is not null").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2"))
                .agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_tails")))
    return materialize(nodes.join(children, ["h1", "h2"], "left").select(
        "h1", "h2", "p1", "p2", "conv_id", "depth", "n_convs",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_children", "n_tails")],
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "nodes")


def shared_paths(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path``: per deepest shared node the nodes from the root to it, with the
    weights that this path accounts for.

    A deepest shared node has several members but no such child.  Its smallest member leads
    through it, so one conversation stands for one path.  A node's weights go with the smallest of those conversations."""
    deepest = materialize(nodes.where("n_convs > 1 and n_children = n_tails")
                          .select("conv_id", F.col("depth").alias("last")), "deepest")
    on = materialize(steps.select("conv_id", "depth", "h1", "h2").join(deepest, "conv_id").where("depth <= last")
                     .drop("last"), "paths")
    owner = on.groupBy("h1", "h2").agg(F.min("conv_id").alias("owner"))
    # a childless node is a pair of parentheses itself; the tails of others are leaves besides
    extra = F.when(F.col("n_children") == F.col("n_tails"), F.greatest(F.col("n_tails") - 1, F.lit(0))).otherwise(F.col("n_tails"))
    weights = nodes.join(owner, ["h1", "h2"]).select(F.col("owner").alias("conv_id"), "depth", "saved", extra.alias("extra"))
    weighed = on.join(weights, ["conv_id", "depth"], "left").select(
        "conv_id", F.struct("depth", "h1", "h2", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("saved", "extra")]).alias("node"))
    path = F.array_sort(F.collect_list("node"))
    rows = weighed.groupBy("conv_id").agg(path.alias("path"))
    return rows.select(F.transform("path", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))).alias("walk"),
                       F.col("path.saved").alias("saved"), F.col("path.extra").alias("extra"))


def subtree_totals(walks: DataFrame) -> DataFrame:
    """``(h1, h2, n_leaves, saved_tokens)`` of every node on ``shared_paths``: the
    shards' parts, summed over the spines that they share."""
    def encoded(batches: Iterator[pa.RecordBatch]):
        def rows():
            for arrow in batches:
                walk, saved, extra = (arrow.column(c) for c in ("walk", "saved", "extra"))
                for i in range(len(arrow)):
                    yield [(x["h1"], x["h2"]) for x in walk[i].as_py()], saved[i].as_py(), extra[i].as_py()

        for nodes, leaves, savings in shard(rows()):
            both = np.array(nodes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (both[:, 0], both[:, 1], leaves, savings)],
                                             ["h1", "h2", "n_leaves", "saved_tokens"])

    ordered = materialize(walks, "walks").repartitionByRange("walk").sortWithinPartitions("walk")
    return (ordered.mapInArrow(encoded, "h1 long, h2 long, n_leaves long, saved_tokens long")
            .groupBy("h1", "h2").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]))


def end_digests(steps: DataFrame, block: int = 4096) -> DataFrame:
    """``(h1, h2, ends_sha256)``: per node where conversations end, the SHA-256 of
    their decimal ids, ascending, comma-joined.  Ids are joined in blocks of an id range
    first; the digest, sequential by nature, streams over a node's blocks."""
    ends = steps.groupBy("conv_id").agg(F.max_by(F.struct("h1", "h2"), "depth").alias("at"))
    blocks = (ends.groupBy(F.col("at.h1").alias("h1"), F.col("at.h2").alias("h2"), F.floor(F.col("conv_id") / block).alias("block"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))

    def digested(batches: Iterator[pa.RecordBatch]):
        out, node, digest = [], None, None
        for arrow in batches:
            for h1, h2, ids in zip(*(arrow.column(c).to_pylist() for c in ("h1", "h2", "ids"))):
                if node != (h1, h2):
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (h1, h2), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if node is not None:
            out.append((*node, digest.hexdigest()))
        if out:
            yield batch_of(out)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))],
                                          ["h1", "h2", "ends_sha256"])

    return (blocks.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "block")
            .mapInArrow(digested, "h1 long, h2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row per node of the prefix trie of the
    rebuilt conversations (``shared_heads``): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, members but one times the UTF-8 bytes of the node's text) and ``ends_sha256``.

    * Turns are ordered by ``turn`` (null first), ties by digest of role and text; repeated rows are
      turns of their own; null roles and texts count as empty.
    * Rows without a ``conv_id`` take no part; an empty table gives no nodes, not even a root.
    * Extra columns are ignored.  Texts never leave the first scan; sequences are told apart by 128 bits.
    * A shared path is one row (16 bytes a node); unshared turns never are.
    """
    known = materialize(numbered_turns(turns), "numbered")
    steps = materialize(passages(shared_heads(known, group, heads), known.select("conv_id").distinct()), "steps")
    nodes = trie_nodes(steps)
    totals = subtree_totals(shared_paths(steps, nodes))
    parent = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(totals, ["h1", "h2"], "left").join(end_digests(steps), ["h1", "h2"], "left")
            .join(parent, ["p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                    F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
                    F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
