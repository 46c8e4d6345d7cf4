"""Packing token sequences by multiway differencing (Karmarkar and Karp).

Every task packs the documents of its own partition as it reads them, so
nothing is shuffled and a task holds one batch of windows at a time.  Whole
windows are cut off long documents; the remainders of a batch are dealt to
``windows`` windows: two partial partitions with the widest spread are merged,
the heaviest window of one with the lightest of the other, until one is left.
If a window then holds more than the capacity, remainders are cut finer, and
after that the number of windows rises.  The small gaps that differencing
leaves are filled with tokens cut off the next documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from citeline.llm.common import materialize
from citeline.llm.subwords import ByteBpe

#: Windows packed together; tokens that each keeps back from the differencing, which leaves them uneven by about
#: that much; and the least gap that is filled afterwards.
WINDOWS, RESERVE, LEAST = 128, 96, 8
PACKED = "row long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal items to ``windows`` windows of nearly equal sums.

    -> the window of every item and the sums.  A partial partition is a vector
    of sums in falling order with the item that stands for each window (-1:
    empty); merging adds one vector to the other in rising order, and joins
    the items of two windows under one of them."""
    leader = np.arange(len(sizes))
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        sums, items = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], items[0] = sizes[i], i
        heap.append((-int(sizes[i]), len(heap), sums, items))
    order = len(heap)
    while len(heap) > 1:
        _, _, sums, items = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        sums, others = sums + other[::-1], others[::-1]
        both = (items >= 0) & (others >= 0)
        leader[others[both]] = items[both]
        items = np.where(items >= 0, items, others)
        fall = np.argsort(-sums, kind="stable")
        sums, items = sums[fall], items[fall]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), order, sums, items))
        order += 1
    if not heap:
        return leader, np.zeros(windows, np.int64)
    _, _, sums, items = heap[0]
    while True:  # follow the leaders to the ones that stand for a window
        up = leader[leader]
        if (up == leader).all():
            break
        leader = up
    place = np.full(len(sizes), -1)
    place[items[items >= 0]] = np.flatnonzero(items >= 0)
    return place[leader], sums


def cut(items: list[tuple], most: int) -> list[tuple]:
    """``(document, start, length)`` items of at most ``most`` tokens, in even parts."""
    out = []
    for doc, start, length in items:
        n = -(-length // most)
        bounds = [start + length * i // n for i in range(n + 1)]
        out += [(doc, a, b - a) for a, b in zip(bounds, bounds[1:])]
    return out


def take(items: list[tuple], tokens: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``tokens`` tokens of the items and the rest, one item cut at most."""
    first, rest = [], []
    for doc, start, length in items:
        head = min(length, tokens)
        tokens -= head
        if head:
            first.append((doc, start, head))
        if length > head:
            rest.append((doc, start + head, length - head))
    return first, rest


def deal(items: list[tuple], capacity: int, windows: int) -> list[list[tuple]]:
    """The items in nearly equal windows of at most ``capacity`` tokens.

    Items stay whole if that fits; else they are cut into halves, quarters and
    so on of the capacity.  When parts of 32 tokens exceed it too, the window
    count rises until they do not."""
    for step in range(max(1, capacity // 32).bit_length()):
        parts = cut(items, max(1, capacity >> step))
        place, sums = differencing(np.array([n for _, _, n in parts]), windows)
        if sums.max() <= capacity:
            break
    while sums.max() > capacity:
        windows += 1
        place, sums = differencing(np.array([n for _, _, n in parts]), windows)
    found: list[list[tuple]] = [[] for _ in range(windows)]
    for part, w in zip(parts, place):
        found[w].append(part)
    return found


def batch(items: list[tuple], windows: int, capacity: int, reserve: int, least: int) -> tuple[list[list[tuple]], list[tuple]]:
    """``windows`` windows from the first items, and the items that are left.

    All but ``reserve`` tokens a window are dealt by differencing; what a
    window is then short of, from ``least`` tokens on, is cut off the following
    items."""
    main, rest = take(items, windows * (capacity - reserve))
    found = deal(main, capacity, windows)
    for window in found:
        short = capacity - sum(n for _, _, n in window)
        if short >= least:
            more, rest = take(rest, short)
            window += more
    return [w for w in found if w], rest


def powers(items: list[tuple], capacity: int) -> list[list[tuple]]:
    """Sequences of falling powers of two over all tokens; none needs padding."""
    out, left = [], sum(n for _, _, n in items)
    while left:
        size = 1 << (min(left, capacity).bit_length() - 1)
        window, items = take(items, size)
        out.append(window)
        left -= size
    return out


def pack(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 1,
         capacity: int = 2048, windows: int = WINDOWS, reserve: int = RESERVE,
         least: int = LEAST) -> DataFrame:
    """``docs`` packed into sequences of at most ``capacity`` tokens -> one row per piece: the
    ``id`` columns of its document (all but ``text``), ``start`` (the document's tokens before it), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` there.

    * A document is its text's ids without special tokens around it, then ``end_id``; null
      text counts as empty, so every row has a token at least.
    * Every id lies in one piece; the pieces of a sequence have no gap.
    * Rows are taken one by one: repeated ids are documents of their own.  Input columns named
      like the added ones are replaced; an empty table gives no pieces.
    * ``sequence_id`` holds the partition in its upper bits, so the packing follows how the input is
      split.  The result is written once and read back: a lost executor cannot mix two packings.
    """
    added = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kept = [c for c in docs.columns if c != text and c not in added]

    def packed(batches: Iterator[pa.RecordBatch]):
        model = ByteBpe(tokenizer, plain_specials=False)
        sequence = TaskContext.get().partitionId() << 32
        tokens: dict[int, np.ndarray] = {}  # ids of the documents that are still open
        rows: dict[int, tuple] = {}
        items: list[tuple] = []
        out: list[tuple] = []
        held = seen = ready = 0

        def emit(found: list[list[tuple]]):
            nonlocal sequence, ready
            for window in found:
                at = 0
                for doc, start, length in window:
                    ids = tokens[doc][start:start + length]
                    out.append((rows[doc], start, length, ids.tobytes(), len(tokens[doc]), sequence, at))
                    at += length
                ready += at
                sequence += 1

        def flush():
            nonlocal out, ready
            columns = list(zip(*out))
            keys = [pa.array([r[k] for r in columns[0]], t) for k, t in enumerate(types)]
            rest = [pa.array(c, t) for c, t in zip(columns[1:], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])]
            out, ready = [], 0
            return pa.RecordBatch.from_arrays(keys + rest, kept + added)

        types: list[pa.DataType] = []
        for arrow in batches:
            types = [arrow.schema.field(c).type for c in kept]
            keys = [arrow.column(c).to_pylist() for c in kept]
            for i, content in enumerate(arrow.column(text)):
                content = content.as_py() or ""
                doc, seen = seen, seen + 1
                tokens[doc] = np.append(model.ids(content), end_id).astype("<u4")
                rows[doc] = tuple(k[i] for k in keys)
                size = len(tokens[doc])
                full = size - size % capacity
                emit([[(doc, at, capacity)] for at in range(0, full, capacity)])
                if full < size:
                    items.append((doc, full, size - full))
                    held += size - full
                else:
                    del tokens[doc], rows[doc]
                while held >= windows * capacity:
                    found, items = batch(items, windows, capacity, reserve, least)
                    emit(found)
                    held = sum(n for _, _, n in items)
                    open_docs = {d for d, _, _ in items}
                    tokens = {d: t for d, t in tokens.items() if d in open_docs}
                    rows = {d: r for d, r in rows.items() if d in open_docs}
                if ready > 1 << 20:
                    yield flush()
        if held >= capacity:  # the last, incomplete batch: as many windows as it fills
            found, items = batch(items, held // capacity, capacity, reserve, least)
            emit(found)
        emit(powers(items, capacity))
        if out:
            yield flush()

    from pyspark.sql import types as T
    schema = T.StructType([*(docs.schema[c] for c in kept), *T._parse_datatype_string(PACKED).fields[1:]])
    return materialize(docs.select(*kept, text).mapInArrow(packed, schema), "packed")
