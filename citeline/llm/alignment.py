"""Alignment of two tokenizers over whole texts by lockstep merging.

Tokens of both sides are byte ranges of the same text.  One state vector holds
an A and a B pointer per lane, a lane being a stretch of a document between
two offsets where both sides end a token; each step compares all lanes' next
ends at once, advances the pointer that is behind, and where both end emits
a link and a cut and advances both.  Finished lanes are compacted away.

Every token has a byte at least, so at a common end exactly one token of each
side ends: the links of a document are the last A and last B token of
every group between two cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.llm.common import materialize
from citeline.llm.subwords import ByteBpe, PieceBpe, runs, text_sizes

#: A tokens between two places where a lane may end.
LANE = 64
LISTS = ["a_ids", "b_ids", "a_ends", "b_ends"]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, every: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the A and B tokens that end at common offsets, in order.

    Both inputs rise strictly and have the same last value (a batch of
    documents lies end to end, so every document's end is common)."""
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    probe = np.unique(np.append(np.arange(every - 1, len(a_ends), every), len(a_ends) - 1))
    at = np.searchsorted(b_ends, a_ends[probe])
    common = b_ends[at] == a_ends[probe]
    a_last, b_last = probe[common], at[common]  # a lane's last tokens
    a, b = np.append(0, a_last[:-1] + 1), np.append(0, b_last[:-1] + 1)
    links_a, links_b = [], []
    while len(a):
        left, right = a_ends[a], b_ends[b]
        both = left == right
        links_a.append(a[both])
        links_b.append(b[both])
        a, b = a + (left <= right), b + (right <= left)
        active = a <= a_last
        if not active.all():
            a, b, a_last = a[active], b[active], a_last[active]
    links_a, links_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(links_a)
    return links_a[order], links_b[order]


class Vocabulary:
    """Byte contents of a tokenizer's ids, for whole arrays of ids."""

    def __init__(self, table: list[bytes]):
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.kind = "<u2" if len(table) <= 1 << 16 else "<u4"

    def spells(self, ids: np.ndarray, content: bytes) -> bool:
        """Whether the ids' bytes are ``content``."""
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        if total != len(content):
            return False
        at = np.arange(total) + np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return bool((self.bytes[at] == np.frombuffer(content, np.uint8)).all())


def _concatenated(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=bounds[1:])
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)).astype(np.int64), bounds


def _marks(last: np.ndarray, of: np.ndarray) -> list[bytes]:
    """Per row, bits that are set at the tokens in ``last``."""
    bits = np.zeros(of[-1], bool)
    bits[last] = True
    return [np.packbits(bits[a:b], bitorder="little").tobytes() for a, b in zip(of[:-1], of[1:])]


def align(docs: DataFrame, text: str = "text", byte_bpe: str = "byte_bpe_50k.json",
          piece_bpe: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with their ``text`` replaced by ``a_ids`` and ``b_ids`` (tokens of a space and the text under
    both tokenizers; little-endian unsigned 16-bit, or 32-bit above 65,536 entries) and ``a_ends``
    and ``b_ends`` (a bit per token, from the lowest: whether a cut follows it).

    Link ``k`` of a row joins its ``k``-th A and B tokens with a set bit.  Strings of special tokens are
    plain text.  Null and empty texts, and texts that either side does not reproduce byte by
    byte, have no tokens.  Rows are taken one by one; other columns stay, such of the
    added names are replaced; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != text and c not in LISTS]

    def aligned(batches: Iterator[pa.RecordBatch]):
        sides = ByteBpe(byte_bpe, plain_specials=True), PieceBpe(piece_bpe)
        words = [Vocabulary(side.table) for side in sides]
        nothing = np.zeros(0, np.int64)
        for arrow in batches:
            for i, j in runs(text_sizes(arrow.column(text))):
                part = arrow.slice(i, j - i)
                texts = part.column(text).to_pylist()
                ids = [[side.ids(lead + x) if x else nothing for x in texts] for side, lead in zip(sides, (" ", ""))]
                whole = [(" " + x).encode() if x else b"" for x in texts]
                if not all(w.spells(np.concatenate(x), b"".join(whole)) for w, x in zip(words, ids)):
                    for k, content in enumerate(whole):
                        if not all(w.spells(x[k], content) for w, x in zip(words, ids)):
                            ids[0][k] = ids[1][k] = nothing
                (a, a_of), (b, b_of) = map(_concatenated, ids)
                links = lockstep(np.cumsum(words[0].sizes[a]), np.cumsum(words[1].sizes[b]))
                lists = [[x.astype(w.kind).tobytes() for x in rows] for w, rows in zip(words, ids)]
                lists += [_marks(last, of) for last, of in zip(links, (a_of, b_of))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(x, pa.binary()) for x in lists)],
                                                 kept + LISTS)

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.BinaryType()) for c in LISTS)])
    return docs.select(*kept, text).mapInArrow(aligned, schema)


def read_runs(arrow: pa.RecordBatch, stored: list[str]):
    """Rows of ``align`` (ids ``stored`` as its ``Vocabulary`` says), about a million ids at a time: the rows ``i..j-1``, and
    per side the ids, their bounds by row and the indexes of those before a cut."""
    for i, j in runs(text_sizes(arrow.column("a_ids")), 1 << 21):
        sides = []
        for ids, ends, kind in zip(LISTS[:2], LISTS[2:], stored):
            rows = [np.frombuffer(x, kind) for x in arrow.column(ids).slice(i, j - i).to_pylist()]
            values, of = _concatenated(rows)
            marks = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(r), bitorder="little")
                     for x, r in zip(arrow.column(ends).slice(i, j - i).to_pylist(), rows)]
            sides.append((values, of, np.flatnonzero(np.concatenate(marks))))
        yield i, j, *sides


def pair_counts(aligned: DataFrame, stored: list[str]) -> DataFrame:
    """``(a_id, b_id, n)``: how many links of all rows hold an id pair.

    Tasks count their own links first, in a table that is emptied when it
    reaches a million pairs."""
    def counted(batches: Iterator[pa.RecordBatch]):
        keys, sums, out = np.zeros(0, np.int64), np.zeros(0, np.int64), ["pair", "n"]
        for arrow in batches:
            for _, _, (a, _, a_last), (b, _, b_last) in read_runs(arrow, stored):
                found, n = np.unique(a[a_last] << 32 | b[b_last], return_counts=True)
                keys, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([sums, n]), len(keys)).astype(np.int64)
                if len(keys) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], out)
                    keys = sums = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], out)

    found = (aligned.select(*LISTS).mapInArrow(counted, "pair long, n long")
             .groupBy("pair").agg(F.sum("n").alias("n")))
    return found.select(F.shiftright("pair", 32).cast("int").alias("a_id"),
                        F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), "n")


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can be linked at all: two tokens that end together
    are equal from the end on as far as the shorter one goes, so one's bytes
    are the end of the other's.  Read off the vocabularies alone."""
    total = 0
    for longer, others in ((a, b), (b, a)):
        known: dict[bytes, int] = {}
        for x in others:
            known[x] = known.get(x, 0) + 1
        total += sum(known.get(x[i:], 0) for x in longer for i in range(len(x)))
    return total


def pair_ranks(counts: DataFrame, a_table: list[bytes], b_table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs (A id in the upper half), their counts, and whether each is
    the most frequent of its B id.

    Their number is bounded by the two vocabularies, not by the corpus
    (``most_pairs``: 345,667 for the given ones), so the arrays may go to every task."""
    bound = most_pairs(a_table, b_table)
    if bound > 1 << 24:
        raise ValueError(f"these vocabularies allow {bound} id pairs, more than the tasks can hold")
    table = counts.toArrow()
    a, b, n = (table.column(c).to_numpy() for c in ("a_id", "b_id", "n"))
    best = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(best, b, n)
    order = np.argsort(keys := a.astype(np.int64) << 32 | b)
    return keys[order], n[order], (n == best[b]).astype(np.int64)[order]


def token_links(docs: DataFrame, text: str = "text", byte_bpe: str = "byte_bpe_50k.json",
                piece_bpe: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row of ``docs`` (``text`` left out) its digest: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose
    id pair is the most frequent of its B id in all rows, ties included), ``count_sum`` (the pairs' counts
    over all links) and ``groups_sha256`` (lowercase hex of the groups, ``;`` between groups, ``|``
    between a group's A and B ids, ``,`` between ids; empty without tokens).

    The alignment is written once and read for both passes."""
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    tables = ByteBpe(byte_bpe, plain_specials=True).table, PieceBpe(piece_bpe).table
    entries = [len(x) for x in tables]
    aligned = materialize(align(docs.drop(*added), text, byte_bpe, piece_bpe), "aligned")
    stored = [Vocabulary(x).kind for x in tables]
    ranks = pair_ranks(materialize(pair_counts(aligned, stored), "pairs"), *tables)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in aligned.columns if c not in LISTS]

    def digested(batches: Iterator[pa.RecordBatch]):
        keys, n, is_best = shared.value
        written = [[f"{i}{mark}".encode() for i in range(m)] for m, marks in zip(entries, (",|", ",;")) for mark in marks]
        for arrow in batches:
            for i, j, (a, a_of, a_last), (b, b_of, b_last) in read_runs(arrow, stored):
                of = np.searchsorted(a_last, a_of)
                at = np.searchsorted(keys, a[a_last] << 32 | b[b_last])
                best, total = (np.diff(np.append(0, np.cumsum(x[at]))[of]) for x in (is_best, n))
                # every group's A ids, then its B ids, each with the mark that follows it
                content = np.empty(len(a) + len(b), object)
                for side, (x, last, other, before) in enumerate(((a, a_last, b_last, True), (b, b_last, a_last, False))):
                    group = np.searchsorted(last, np.arange(len(x)))
                    ahead = np.append(0, other + 1)[group] if before else (other + 1)[group]
                    spelled = np.array([written[2 * side][v] for v in x.tolist()], object)
                    spelled[last] = [written[2 * side + 1][v] for v in x[last].tolist()]
                    content[np.arange(len(x)) + ahead] = spelled
                hashes = []
                for lo, hi in zip((a_of + b_of)[:-1], (a_of + b_of)[1:]):
                    hashes.append(hashlib.sha256(b"".join(content[lo:hi].tolist())[:-1]).hexdigest() if hi > lo else "")
                groups = np.diff(of)
                yield pa.RecordBatch.from_arrays(
                    [*(arrow.column(c).slice(i, j - i) for c in kept),
                     *map(pa.array, (np.diff(a_of), np.diff(b_of), groups, groups, best, total)), pa.array(hashes)], kept + added)

    schema = T.StructType([*(aligned.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in added[:6]),
                           T.StructField(added[6], T.StringType())])
    return aligned.mapInArrow(digested, schema)
