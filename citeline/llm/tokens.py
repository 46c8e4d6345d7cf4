"""Vectorised word hashing for Arrow batches of texts.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing
A-Z; every word gets a 64-bit hash (polynomial prefix sums over the bytes, then
a bit mixer).  Work runs in pieces of about a megabyte, so neither a batch nor
one very long text is expanded at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
        0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    if cache.get("n", 0) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        cache.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return cache["up"], cache["down"]


def _byte_tables(cache: dict) -> tuple[np.ndarray, np.ndarray]:
    if "lower" not in cache:
        lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
        lower[65:91] += np.uint64(32)
        gap = np.zeros(256, bool)
        gap[[32, 9, 10, 11, 12, 13]] = True
        symbol = np.arange(256) < 128
        symbol[48:58] = symbol[65:91] = symbol[97:123] = False
        cache.update(lower=lower, gap=gap, symbol=symbol)
    return cache["lower"], cache["gap"]


def hash_words(data: np.ndarray, cuts: np.ndarray, cache: dict, prefixes: tuple[int, ...] = (),
               alphanumeric: bool = False):
    """Hashes and byte starts of the words in ``data``; ``cuts`` are offsets at
    which a word ends in any case (text boundaries).  With ``alphanumeric``,
    ASCII punctuation and controls end words too.  ``prefixes`` adds, per
    length, the hashes of the words' first bytes as further rows."""
    n = len(data)
    if not n:
        return np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64), np.zeros(0, np.int64)
    lower, gap = _byte_tables(cache)
    if alphanumeric:
        gap = cache["symbol"]
    up, down = _powers(n, cache)
    solid = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[cuts[cuts <= n]] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(lower[data] * up[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    if not prefixes:
        return words, starts
    heads = [mix((sums[np.minimum(ends, starts + k)] - sums[starts]) * down[starts] ^ np.uint64(_ODD[k % 8]))
             for k in prefixes]
    return np.stack([words, *heads]), starts


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _long_text(data: np.ndarray, cache: dict) -> np.ndarray:
    """Word hashes of one text of any length, cut into pieces at white space."""
    _, gap = _byte_tables(cache)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            back = np.flatnonzero(gap[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
                break
            end = min(end + PIECE, len(data))
        out.append(hash_words(data[at:end], np.zeros(0, np.int64), cache)[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words_of_texts(column: pa.Array, cache: dict):
    """Yield ``(i, j, words, owner)`` for consecutive texts ``i..j-1``: the word
    hashes in order and, for each, its text's index minus ``i``."""
    data, offsets = text_buffers(column)
    i, count = 0, len(column)
    while i < count:
        if offsets[i + 1] - offsets[i] > PIECE:
            words = _long_text(data[offsets[i]:offsets[i + 1]], cache)
            yield i, i + 1, words, np.zeros(len(words), np.int64)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        cuts = offsets[i:j + 1] - offsets[i]
        words, starts = hash_words(data[offsets[i]:offsets[j]], cuts, cache)
        yield i, j, words, np.searchsorted(cuts, starts, "right") - 1
        i = j


def shingles(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles in text order, the text index of each,
    and each shingle's word position in the array.  A text with fewer words
    has its whole word sequence as its one shingle."""
    size = len(words)
    total = np.zeros(size, np.uint64)
    whole = np.ones(size, bool)
    for k in range(n):
        same = np.zeros(size, bool)
        same[:size - k] = owner[k:] == owner[:size - k] if size > k else False
        shifted = np.zeros(size, np.uint64)
        shifted[:max(0, size - k)] = words[k:]
        total += np.where(same, shifted * np.uint64(_ODD[k % len(_ODD)] + 2 * (k // len(_ODD))), np.uint64(0))
        whole &= same
    start = np.ones(size, bool)
    start[1:] = owner[1:] != owner[:-1]
    at = np.flatnonzero(whole | start)
    return mix(total[at]), owner[at], at
