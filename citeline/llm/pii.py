"""Personal data: patterns, and terms that give protected entities away.

Emails, IP addresses, card and phone numbers are found by pattern.  They are the
protected entities of an information-theoretic sanitisation: from counts over
the whole corpus, a term ``t`` discloses an entity ``c`` by the share of ``c``'s
information that it carries, ``PMI(t; c) / IC(c)`` (1 if ``t`` never occurs
without ``c``).  Terms above a threshold are generalised wherever they occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import BROADCAST_ROWS, materialize
from citeline.llm.tokens import PIECE, hash_words, text_buffers

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The domain of an email, after its "@".  Possessive forms match what the greedy ones do, in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A term this many words before or after an entity is in its context; terms have at least this many bytes.
CONTEXT = 6
MIN_BYTES = 3
PLACEHOLDER = {kind: f"[{kind.upper()}]" for kind in KINDS}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns: per kind leftmost, without overlap;
    matches that fail their check are dropped, not tried again."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        match = DOMAIN.match(text, at)
        start = at
        while match and start > done and text[start - 1] in LOCAL:
            start -= 1
        if match and start < at:
            out.append((start, match.end(), "email"))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _entity(kind: str, value: str) -> bytes:
    value = value.translate(LOWER) if kind in ("email", "ip") else re.sub(r"[^0-9]", "", value)
    return hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest()


def _hash(words: list[str], cache: dict) -> np.ndarray:
    """Hashes of single words, equal to those of the same words in texts."""
    data = [w.encode("utf-8") for w in words]
    if not data:
        return np.zeros(0, np.int64)
    ends = np.cumsum([len(d) for d in data])
    hashes, _ = hash_words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends]), cache, alphanumeric=True)
    return hashes.astype(np.int64)


def _context(text: str, spans, start: int, end: int) -> list[str]:
    """Lower-cased terms around a span, outside all spans."""
    def free(m):
        return not any(s < m.end() and m.start() < e for s, e, _ in spans)
    before = [m for m in WORD.finditer(text, max(0, start - 40 * CONTEXT), start) if free(m)][-CONTEXT:]
    after = [m for m, _ in zip((m for m in WORD.finditer(text, end, min(len(text), end + 40 * CONTEXT)) if free(m)), range(CONTEXT))]
    return [m[0].translate(LOWER) for m in before + after]


def _cooccurrences(batches: Iterator[pa.RecordBatch]):
    """(entity, term, document, context digest) for the terms around entities;
    the null term stands for the entity itself."""
    cache: dict = {}
    for batch in batches:
        out = [[], [], [], []]
        for doc, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            spans = base_spans(text) if text else ()
            for start, end, kind in spans:
                entity = int.from_bytes(_entity(kind, text[start:end]), "big", signed=True)
                near = spans if len(spans) < 50 else [s for s in spans if s[0] < end + 400 and s[1] > start - 400]
                terms = sorted({t for t in _context(text, near, start, end) if len(t.encode()) >= MIN_BYTES})
                seen = int.from_bytes(hashlib.blake2b(" ".join(terms).encode(), digest_size=8).digest(), "big", signed=True)
                for term in [None, *_hash(terms, cache).tolist()]:
                    for column, value in zip(out, (entity, term, doc, seen)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["entity", "term", "doc", "seen"])


def _term_counts(known):
    """(term, documents of the batch that hold it), only ``known`` terms if given."""
    def count(batches: Iterator[pa.RecordBatch]):
        cache: dict = {}
        for batch in batches:
            found = []
            for owner, terms in _owned_terms(batch.column("text"), cache):
                if known is not None:
                    inside = np.isin(terms, known.value)
                    owner, terms = owner[inside], terms[inside]
                order = np.lexsort((terms, owner))
                owner, terms = owner[order], terms[order]
                first = np.ones(len(terms), bool)
                first[1:] = (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])
                found.append((owner[first], terms[first]))
            if found:
                owner, terms = (np.concatenate(x) for x in zip(*found))
                both = np.unique(np.stack([terms, owner]), axis=1) if len(terms) else np.zeros((2, 0), np.int64)
                values, n = np.unique(both[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])
    return count


def _owned_terms(column: pa.Array, cache: dict):
    """Yield ``(text index, term hash)`` piece by piece; a long text is cut at
    white space."""
    data, offsets = text_buffers(column)
    i, count = 0, len(column)
    while i < count:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        at = int(offsets[i])
        while at < offsets[j]:
            stop = int(offsets[j])
            if stop - at > PIECE:  # one long text
                hash_words(data[at:at + 1], np.zeros(0, np.int64), cache)
                gaps = np.flatnonzero(cache["gap"][data[at:at + PIECE]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
            hashes, starts = hash_words(data[at:stop], offsets[i:j + 1] - at if at == offsets[i] else np.zeros(0, np.int64),
                                        cache, alphanumeric=True)
            yield np.searchsorted(offsets, starts + at, "right") - 1, hashes.astype(np.int64)
            at = stop
        i = j


def disclosing_terms(docs: DataFrame, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """``(term)``: hashes of the terms that disclose some entity.

    With ``n_c`` documents that hold entity ``c``, ``n_t`` that hold term ``t``,
    ``n_tc`` that hold ``t`` in a context of ``c``, and ``n`` documents, a term
    discloses if ``log(n_tc * n / (n_t * n_c)) >= threshold * log(n / n_c)`` and it
    occurs in at least ``support`` different contexts of ``c``.  All counts cover
    the whole corpus.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    near = materialize(rows.mapInArrow(_cooccurrences, "entity long, term long, doc long, seen long"), "cooccurrences")
    pair = (near.where("term is not null").groupBy("entity", "term")
            .agg(F.count_distinct("seen").alias("contexts"), F.count_distinct("doc").alias("n_tc"))
            .where(F.col("contexts") >= support))
    pair = materialize(pair.join(near.where("term is null").groupBy("entity").agg(F.count_distinct("doc").alias("n_c")), "entity"),
                       "pairs")
    terms = materialize(pair.select("term").distinct(), "terms")
    known = None
    if terms.count() <= BROADCAST_ROWS:
        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in terms.collect()], np.int64)))
    counts = (docs.select("text").mapInArrow(_term_counts(known), "term long, n long")
              .groupBy("term").agg(F.sum("n").alias("n_t")))
    n = docs.count()
    value = F.log(F.col("n_tc") * F.lit(float(n)) / (F.col("n_t") * F.col("n_c")))
    return pair.join(counts, "term").where(
        value >= threshold * F.log(F.lit(float(max(n, 1))) / F.col("n_c")) - 1e-12).select("term").distinct()


def _word_spans(batches: Iterator[pa.RecordBatch]):
    """(key, term, start, end) of every word: the way for term lists of any size."""
    cache: dict = {}
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            words = list(WORD.finditer(text)) if text else []
            for at in range(0, len(words), 10000):
                part = words[at:at + 10000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(part), pa.int64()), pa.array(_hash([m[0].translate(LOWER) for m in part], cache)),
                     pa.array([m.start() for m in part], pa.int64()), pa.array([m.end() for m in part], pa.int64())],
                    ["key", "term", "start", "end"])


SPANS = "array<struct<start:long,end:long,kind:string>>"


def _sanitise(known):
    """Adds ``spans`` and ``sanitised`` to each row; term spans come from the
    ``known`` hashes or, if there are too many, from the column ``terms``."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def emit(batches: Iterator[pa.RecordBatch]):
        cache: dict = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            listed = batch.column("terms").to_pylist() if known is None else None
            hold = np.zeros(len(texts), bool)
            if known is not None and len(known.value):
                for owner, terms in _owned_terms(batch.column("text"), cache):
                    hold[owner[np.isin(terms, known.value)]] = True
            out, clean = [], []
            for i, text in enumerate(texts):
                found = base_spans(text) if text else []
                terms = [(t["start"], t["end"]) for t in listed[i] or ()] if listed else []
                if hold[i]:
                    words = list(WORD.finditer(text))
                    inside = np.isin(_hash([m[0].translate(LOWER) for m in words], cache), known.value)
                    terms = [words[k].span() for k in np.flatnonzero(inside)]
                if terms:
                    covered = np.zeros(len(text) + 1, bool)
                    for s, e, _ in found:
                        covered[s:e] = True
                    found = sorted(found + [(s, e, "term") for s, e in terms if not covered[s:e].any()],
                                   key=lambda x: (x[0], KINDS.index(x[2])))
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                if text and found:
                    parts, at = [], 0
                    for s, e, kind in found:
                        if s >= at:
                            parts += [text[at:s], PLACEHOLDER[kind]]
                        at = max(at, e)
                    text = "".join(parts) + text[at:]
                clean.append(text)
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "terms"]
            names = [name for name in batch.schema.names if name != "terms"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, span), pa.array(clean, pa.string())],
                                             [*names, "spans", "sanitised"])
    return emit


def sanitise(docs: DataFrame, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` plus ``spans`` - (start, end, kind) in code points,
    by start and kind: email, ip, card, phone, and term - and ``sanitised``, the
    text with every span replaced by a placeholder.

    Base spans always stay; a term inside one adds nothing.  Null texts keep a
    null ``sanitised`` and no spans.  Rows equal in ``doc_id`` and text count as
    one document in the corpus counts; every row is returned.  Only ``doc_id`` and
    ``text`` are kept of the input's columns.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    terms = materialize(disclosing_terms(docs, threshold, support), "disclosing")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    result = f"{fields}, spans {SPANS}, sanitised string"
    if terms.count() <= BROADCAST_ROWS:
        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in terms.collect()], np.int64)))
        return docs.mapInArrow(_sanitise(known), result)
    key = F.xxhash64("doc_id", "text")
    words = docs.select(key.alias("key"), "text").distinct().mapInArrow(_word_spans, "key long, term long, start long, end long")
    places = words.join(terms, "term").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("terms"))
    rows = docs.withColumn("key", key).join(places, "key", "left").drop("key")
    return rows.mapInArrow(_sanitise(None), result)
