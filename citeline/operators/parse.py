"""Parsers for generated text (L2-L5): persona lists, query lists, sub-topic
lists and markdown outlines.  Each is an array expression over one text —
``split`` into lines, per-line rules, ``filter``, ``slice`` — so parsing a
table of responses is a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.functions import text as tx

# List limits and minimum item lengths per list kind.
PERSONAS, PERSONA_MIN = 3, 10
QUERIES, QUERY_MIN = 3, 3
SUBTOPICS, SUBTOPIC_MIN = 3, 10
DEFAULT_PERSONA = "Expert generaliste: couvre tous les aspects du sujet"

OUTLINE_LINE = "(?s)^(#{1,3}) (.*)$"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped_lines(text: Column) -> Column:
    """Lines of a response, each stripped (shared by the list parsers)."""
    return F.transform(_lines(text), tx.py_strip)


def persona_items(text: Column, limit: int = PERSONAS, lines: Column | None = None) -> Column:
    """L2: numbered lines lose their ``N.`` prefix; lines over 10 characters
    are kept (numbered or not); the first ``limit``; never empty.
    ``lines``: the already stripped lines, if computed once for several parsers."""
    def one(s):
        numbered = s.rlike("^" + tx.DIGIT) & (F.instr(F.left(s, F.lit(3)), ".") > 0)
        return F.when(numbered, tx.py_strip(F.regexp_replace(s, "^[^.]*\\.", ""))).otherwise(s)
    src = lines if lines is not None else stripped_lines(text)
    items = F.slice(F.filter(F.transform(src, one), lambda s: F.length(s) > PERSONA_MIN), 1, limit)
    return F.when(F.size(items) == 0, F.array(F.lit(DEFAULT_PERSONA))).otherwise(items)


def dash_items(text: Column, min_len: int, limit: int, lines: Column | None = None) -> Column:
    """L3/L4: strip, drop a leading run of '-' and ' ', strip; keep lines
    longer than ``min_len``; the first ``limit``."""
    src = lines if lines is not None else stripped_lines(text)
    items = F.transform(src, lambda s: tx.py_strip(F.regexp_replace(s, "^[- ]+", "")))
    return F.slice(F.filter(items, lambda s: F.length(s) > min_len), 1, limit)


def query_items(text: Column, lines: Column | None = None) -> Column:
    return dash_items(text, QUERY_MIN, QUERIES, lines)


def subtopic_items(text: Column, lines: Column | None = None) -> Column:
    return dash_items(text, SUBTOPIC_MIN, SUBTOPICS, lines)


def outline_sections(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``# ``/``## ``/``### `` lines (after stripping) become sections
    ``(sec_no, level, title)`` in order; other lines are ignored."""
    stripped = F.transform(_lines(F.col(text)), lambda line: tx.py_strip(line))
    heads = F.filter(stripped, lambda s: s.rlike(OUTLINE_LINE))
    secs = F.transform(heads, lambda s: F.struct(
        F.length(F.regexp_extract(s, OUTLINE_LINE, 1)).cast("long").alias("level"),
        tx.py_strip(F.regexp_extract(s, OUTLINE_LINE, 2)).alias("title")))
    return (df.select(*keys, F.posexplode(secs).alias("i", "s"))
            .select(*keys, (F.col("i") + 1).cast("long").alias("sec_no"), "s.level", "s.title"))
