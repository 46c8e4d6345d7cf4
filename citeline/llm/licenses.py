"""License scan with ordered signature rules, in DataFrame functions only.

Rules are regular expressions over the text's words, built from license names
and statement forms.  A document is scanned only if it holds a
string without which no rule can match, and a rule runs only if its keyword is
among the document's words.  Rules have priorities; a detection is suppressed
when one of the same or a better priority covers its words.  Fixed phrases are found besides the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm.decontaminate import UPPER

#: Fixed phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, words of the name as a pattern, keyword): the more specific names first.
NAMES = (
    ("agpl", "(?:gnu )?affero general public", "affero"), ("agpl", "agpl", "agpl"),
    ("lgpl", "(?:gnu )?lesser general public", "lesser"), ("lgpl", "lgpl", "lgpl"),
    ("gpl", "(?:gnu )?general public", "general"), ("gpl", "gpl", "gpl"), ("fdl", "gnu free documentation", "documentation"),
    ("apache", "apache", "apache"), ("mit", "mit", "mit"), ("bsd", "bsd(?: [0-9] clause)?", "bsd"),
    ("bsd", "[0-9] clause bsd", "clause"), ("mpl", "mozilla public", "mozilla"), ("mpl", "mpl", "mpl"),
    ("epl", "eclipse public", "eclipse"), ("epl", "epl", "epl"), ("cddl", "common development and distribution", "development"),
    ("cddl", "cddl", "cddl"), ("cc-by-nc-sa", "cc by nc sa", "nc"), ("cc-by-nc-nd", "cc by nc nd", "nc"),
    ("cc-by-nc", "cc by nc", "nc"), ("cc-by-sa", "cc by sa", "sa"), ("cc-by-nd", "cc by nd", "nd"),
    ("cc-by", "cc by", "cc"), ("cc-by", "creative commons attribution", "commons"),
    ("cc0", "cc0", "cc0"), ("cc0", "creative commons zero", "zero"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"),
    ("boost", "boost software", "boost"), ("artistic", "artistic", "artistic"), ("psf", "python software foundation", "python"),
    ("afl", "academic free", "academic"), ("osl", "open software", "software"), ("ofl", "(?:sil )?open font", "font"),
    ("eupl", "european union public", "european"), ("eupl", "eupl", "eupl"), ("wtfpl", "wtfpl", "wtfpl"),
    ("unlicense", "unlicense", "unlicense"), ("postgresql", "postgresql", "postgresql"), ("openssl", "openssl", "openssl"),
    ("php", "php", "php"), ("lppl", "latex project public", "latex"), ("ncsa", "university of illinois", "illinois"),
    ("ms-pl", "microsoft public", "microsoft"), ("odbl", "open database", "database"), ("x11", "x11", "x11"),
)
#: Words that go with "under" in a statement that need not say "license".
VERBS = ("released", "distributed", "published", "available")
#: (priority, confidence, form of the statement around a name).
FORMS = (
    (0, 1.0, "spdx license identifier {name}(?: [0-9]+){{0,2}}"),
    (1, 0.95, f"(?:licensed|{'|'.join(VERBS)}) under " "(?:the )?(?:terms of )?(?:the )?{name}"
              "(?: public)?(?: licen[sc]e)?(?: v(?:ersion)?)?(?: [0-9]+){{0,2}}"),
    (2, 0.9, "(?:subject to|governed by|covered by|see) (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)"),
    (2, 0.85, "{name}(?: public)? licen[sc]e(?: v(?:ersion)?)?(?: [0-9]+){{1,2}}"),
    (3, 0.7, "{name}(?: public)? licen[sc]e"),
    (4, 0.5, "licen[sc]e {name}"),
    (4, 0.5, "{name} licensed"),
)
LEVELS = 1 + max(priority for priority, _, _ in FORMS)
#: Every match of a rule holds one of these.
GATE = ("licen", "spdx", *(f" {verb} under " for verb in VERBS))


def rules() -> list[tuple[str, str, str, int, float]]:
    """All (label, keyword, pattern, priority, confidence): every name in every form."""
    return [(label, keyword, f"(?<= ){form.format(name=name)}(?= )", priority, confidence)
            for priority, confidence, form in FORMS for label, name, keyword in NAMES]


def _count_words(text: Column) -> Column:
    """Words in a piece of spaced text."""
    trimmed = F.trim(text)
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


SPAN = "array<struct<start:int,stop:int,priority:int,label:string,confidence:double>>"


def _detections(spaced: Column) -> Column:
    """All rule matches as (start, stop, priority, label, confidence) in words."""
    table = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern"),
                               F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))
                      for label, keyword, pattern, priority, confidence in rules()))
    words = F.array_distinct(F.split(spaced, " "))
    gated = F.filter(table, lambda r: F.array_contains(words, r["keyword"]))
    matched = F.filter(gated, lambda r: F.regexp_like(spaced, r["pattern"]))

    def spans(r):
        found = F.regexp_extract_all(spaced, r["pattern"], F.lit(0))
        gaps = F.split(spaced, r["pattern"], -1)
        step = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(
            _count_words(g).alias("skip"), _count_words(m).alias("len")))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(step, empty, lambda acc, s: F.struct(
            (acc["at"] + s["skip"] + s["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["skip"]).alias("start"), (acc["at"] + s["skip"] + s["len"]).alias("stop"),
                r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))).alias("out")))["out"]
    return F.flatten(F.transform(matched, spans))


def _unsuppressed(found: Column) -> Column:
    """Detections not covered by one of the same or a better priority (equal
    spans: the better priority, then the smaller label).  One sweep by start,
    longest first, with the furthest end so far per priority."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(
        d["start"].alias("start"), (-d["stop"]).alias("before"), d["priority"].alias("priority"), d["label"].alias("label"),
        d["confidence"].alias("confidence"))))
    state = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("ends"), F.array().cast(SPAN).alias("out"))

    def sweep(acc, d):
        stop = -d["before"]
        covered = F.exists(F.slice(acc["ends"], F.lit(1), d["priority"] + 1), lambda end: end >= stop)
        kept = F.struct(d["start"].alias("start"), stop.alias("stop"), d["priority"].alias("priority"),
                        d["label"].alias("label"), d["confidence"].alias("confidence"))
        return F.struct(
            F.transform(acc["ends"], lambda end, i: F.when(i == d["priority"], F.greatest(end, stop)).otherwise(end)).alias("ends"),
            F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept))).alias("out"))
    return F.aggregate(ordered, state, sweep)["out"]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row: ``doc_id``, ``n_words``;
    ``n_base`` (places of the fixed phrases), ``first_word`` and ``last_word`` (their
    smallest and largest start, words from 0, else null), ``base_labels``;
    ``labels`` (phrases' and rules' labels; distinct, sorted, comma-joined),
    ``score`` (0 to 1: the best confidence; 0.6 for a phrase alone) and
    ``detections``, the rule matches that stand (start and stop in words,
    priority, label, confidence).

    Words are runs of letters, digits and non-ASCII characters after lower-casing
    A-Z.  Null, empty and wordless texts have no words and no labels.  Rows are
    independent of each other; repeated rows give repeated results; extra columns
    are ignored.
    """
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower())
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    rows = docs.select("doc_id", F.concat(F.lit(" "), words, F.lit(" ")).alias("spaced"))
    rows = rows.withColumn("n_words", _count_words(F.col("spaced")).cast("long"))
    # every word between two spaces of its own, so that neighbouring phrases share none
    double = F.replace(F.col("spaced"), F.lit(" "), F.lit("  "))
    count, first, last, labels = [], [], [], []
    for phrase, label in PHRASES:
        needle = f" {phrase.replace(' ', '  ')} "
        size = len(phrase.split())
        there = F.contains("spaced", F.lit(f" {phrase} "))
        text = F.when(there, double)
        n = (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)
        count.append(F.coalesce(n, F.lit(0)).cast("long"))
        first.append(_count_words(F.replace(F.substring_index(text, needle, 1), F.lit("  "), F.lit(" "))))
        last.append(F.col("n_words") - size
                    - _count_words(F.replace(F.substring_index(text, needle, -1), F.lit("  "), F.lit(" "))))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_sort(F.array_compact(F.array(*labels)))
    gate = reduce(Column.__or__, (F.contains("spaced", F.lit(part)) for part in GATE))
    found = F.when(gate, _unsuppressed(_detections(F.col("spaced")))).otherwise(F.array().cast(SPAN))
    rows = rows.select(
        "doc_id", "n_words", sum(count[1:], count[0]).alias("n_base"), F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"), base.alias("base"), found.alias("detections"))
    both = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, 0.6).otherwise(0.0)).alias("score"), "detections")
