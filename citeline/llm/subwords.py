"""Subword ids of whole texts in Arrow tasks.

``byte_bpe`` reads a ``tokenizers`` file, ``piece_bpe`` a ``sentencepiece``
model.  A text longer than ``LONG`` characters is encoded part by part: it is
cut at a single space between two characters that are neither white space nor
the piece model's space mark (U+2581).  No token of the byte-level BPE crosses
such a cut (its pre-tokenizer ends a token there), nor one of the piece model
unless a piece holds the mark behind another character; then texts stay whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

LONG = 1 << 16
_CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
#: Characters that the two byte-level libraries certainly class alike: ASCII, Latin letters, dashes and quotes.
_COMMON = re.compile("[\n\x20-\x7eÀ-ɏ‐-‧]*")
#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def file_of(name: str) -> str:
    """Place of a vocabulary file: ``name`` itself if it is a path, else the
    file of that name in the installed ``public_tokenizers`` package."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(text: str) -> list[tuple[str, bool]]:
    """``text`` in parts of about ``LONG`` characters, and for each whether the
    space at the cut before it was left out."""
    out, at, cut = [], 0, False
    while len(text) - at > LONG:
        found = _CUT.search(text, at + LONG)
        if found is None:
            break
        out.append((text[at:found.start()], cut))
        at, cut = found.end(), True
    return [*out, (text[at:], cut)]


def _same_ranks(spec: dict) -> bool:
    """Whether the file's ids rank its merges, under the usual pattern."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    usual = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
    plain = not spec["normalizer"] and not model.get("ignore_merges") and len(set(ids)) == len(ids)
    return usual and plain and min(ids) >= 256 and all(np.diff(ids) > 0)


class ByteBpe:
    """Ids of a byte-level BPE file, without special tokens around the text.

    ``table[i]`` holds the bytes of id ``i``.  With ``plain_specials`` the
    strings of special tokens inside a text are ordinary text.  Texts of
    common characters go through ``tiktoken`` on the same vocabulary, which
    gives the same ids in a third of the time; all others, texts with a special
    string, and files that differ from the usual form through ``tokenizers``.
    """

    def __init__(self, name: str, plain_specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(file_of(name), encoding="utf-8") as f:
            spec = json.load(f)
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.model.encode_special_tokens = plain_specials
        # fixed values: the byte alphabet of byte-level BPE keeps printable characters and moves the others up from 256
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(kept)]
        symbols = {**{chr(b): b for b in kept}, **{chr(256 + i): b for i, b in enumerate(moved)}}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(symbols[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if entry not in added}
        self.table = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for content, i in [*vocab.items(), *((a.encode(), i) for a, i in added.items())]:
            self.table[i] = content
        self.special = re.compile("|".join(map(re.escape, added))) if added and not plain_specials else None
        self.fast = None
        if _same_ranks(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        out = []
        for part, cut in parts(text):
            part = " " + part if cut else part
            if self.fast and _COMMON.fullmatch(part) and not (self.special and self.special.search(part)):
                out += self.fast.encode_ordinary(part)
            else:
                out += self.model.encode(part, add_special_tokens=False).ids
        return np.array(out, np.int64)


class PieceBpe:
    """Ids of a ``sentencepiece`` model; ``table[i]`` holds the bytes of id
    ``i`` with the space mark as a space."""

    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=file_of(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces)

    def ids(self, text: str) -> np.ndarray:
        """The model puts a space before a text itself, so a part's left-out
        space comes back."""
        texts = [part for part, _ in parts(text)] if self.cuts else [text]
        return np.array([i for row in self.model.encode(texts, num_threads=1) for i in row], np.int64)


def runs(sizes, limit: int = 1 << 20):
    """Consecutive items as ``(i, j)`` of about ``limit`` in size together; a
    larger item is a run of its own."""
    i, total = 0, 0
    for j, size in enumerate(sizes):
        if j > i and total + size > limit:
            yield i, j
            i, total = j, 0
        total += size
    if i < len(sizes):
        yield i, len(sizes)


def text_sizes(column) -> np.ndarray:
    """Bytes of every text of an Arrow column; null counts as none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
