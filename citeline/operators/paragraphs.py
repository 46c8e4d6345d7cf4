"""Paragraph split, score, top-30 and budget.

The whole pipeline for one text is an array expression evaluated inside one
projection, so extracting main content from a corpus is a map-only stage.
The exploded forms (``paragraph_scores``, ``top_paragraphs``) are also
narrow: ``posexplode`` never shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.functions import text as tx
from citeline.functions.arrays import budget_truncate

MIN_LEN = 40          # keep paragraphs strictly longer than this
LONG_LEN = 200        # +1 when strictly longer than this
MANY_WORDS = 30       # +1 when strictly more words than this
TOP_N = 30
JOIN_SEP = "\n\n"


def _split_regex(sep: str) -> str:
    return sep if re.fullmatch(r"[\n\r\t ]+", sep) else "\\Q" + sep + "\\E"


def paragraph_score(p: Column) -> Column:
    """0..5 points."""
    one, zero = F.lit(1), F.lit(0)
    return (F.when(p.rlike(tx.P["four_digits"]), one).otherwise(zero)
            + F.when(F.length(p) > LONG_LEN, one).otherwise(zero)
            + F.when(p.rlike(tx.P["signal"]), F.lit(2)).otherwise(zero)
            + F.when(tx.word_count(p) > MANY_WORDS, one).otherwise(zero))


def _kept(text: Column, sep: str) -> Column:
    """(pos, p) for every piece longer than 40 characters."""
    parts = F.split(F.coalesce(text, F.lit("")), _split_regex(sep), -1)
    indexed = F.transform(parts, lambda p, i: F.struct(i.alias("pos"), p.alias("p")))
    return F.filter(indexed, lambda x: F.length(x["p"]) > MIN_LEN)


def ranked_expr(text: Column, sep: str = JOIN_SEP, top_n: int = TOP_N) -> Column:
    """T9+T10: best ``top_n`` paragraphs, score descending, document order on ties."""
    scored = F.transform(_kept(text, sep), lambda x: F.struct(
        (-paragraph_score(x["p"])).alias("neg_score"), x["pos"].alias("pos"), x["p"].alias("p")))
    return F.slice(F.array_sort(scored), 1, top_n)


def main_content_expr(text: Column, sep: str = JOIN_SEP, max_chars: int = 15000,
                      top_n: int = TOP_N) -> Column:
    """T12 pipeline on text whose paragraphs are separated by ``sep``."""
    pieces = F.transform(ranked_expr(text, sep, top_n), lambda x: x["p"])
    return F.array_join(budget_truncate(pieces, max_chars), JOIN_SEP)


def paragraph_scores(df: DataFrame, key: str, text: str, sep: str = JOIN_SEP) -> DataFrame:
    """One row per kept paragraph: (key, pos, score, n_chars, n_words)."""
    return (df.select(key, F.explode(_kept(F.col(text), sep)).alias("x"))
            .select(key, F.col("x.pos").alias("pos"),
                    paragraph_score(F.col("x.p")).alias("score"),
                    F.length("x.p").alias("n_chars"),
                    tx.word_count(F.col("x.p")).alias("n_words")))


def top_paragraphs(df: DataFrame, key: str, text: str, sep: str = JOIN_SEP,
                   max_chars: int = 15000, top_n: int = TOP_N) -> DataFrame:
    """One row per selected paragraph after the budget: (key, rank, pos, score, piece)."""
    # rank once, then budget: two projections, so the ranking is not evaluated twice
    ranked = df.select(key, ranked_expr(F.col(text), sep, top_n).alias("_r"))
    pieces = budget_truncate(F.transform(F.col("_r"), lambda x: x["p"]), max_chars)
    sel = F.arrays_zip(F.col("_r").alias("r"), pieces.alias("piece"))
    return (ranked.select(key, F.posexplode(sel).alias("i", "z"))
            .where(F.col("z.piece").isNotNull())
            .select(key, (F.col("i") + 1).alias("rank"), F.col("z.r.pos").alias("pos"),
                    (-F.col("z.r.neg_score")).alias("score"), F.col("z.piece").alias("piece")))


def with_main_content(df: DataFrame, text: str, out: str = "content", sep: str = JOIN_SEP,
                      max_chars: int = 15000, top_n: int = TOP_N) -> DataFrame:
    return df.withColumn(out, main_content_expr(F.col(text), sep, max_chars, top_n))
