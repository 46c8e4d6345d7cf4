"""Per-row array helpers: ordered concatenation and character budgets.

These run inside one projection (higher-order functions on the JVM), so an
operator that only needs the pieces of one row (paragraphs of one document,
lines of one context) never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def budget_truncate(pieces: Column, max_chars: int | Column) -> Column:
    """B1 on an array of strings: keep whole pieces while the running total
    stays within ``max_chars``; the first piece that crosses it is cut to the
    remainder (possibly to ''), and nothing follows it."""
    max_c = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    init = F.struct(F.lit(0).alias("total"), F.lit(False).alias("done"),
                    F.array().cast("array<string>").alias("out"))

    def step(acc, p):
        crossing = acc["total"] + F.length(p) > max_c
        return (F.when(acc["done"], acc)
                .when(crossing, F.struct(acc["total"].alias("total"), F.lit(True).alias("done"),
                                         F.array_append(acc["out"], F.left(p, max_c - acc["total"])).alias("out")))
                .otherwise(F.struct((acc["total"] + F.length(p)).alias("total"), F.lit(False).alias("done"),
                                    F.array_append(acc["out"], p).alias("out"))))

    return F.aggregate(pieces, init, step, lambda acc: acc["out"])


def budget_exclude(pieces: Column, max_chars: int) -> Column:
    """B3 on an array of strings: keep pieces while the running total of
    their lengths (separators not counted) stays within ``max_chars``; the
    crossing piece and everything after it are dropped."""
    init = F.struct(F.lit(0).alias("total"), F.lit(False).alias("done"),
                    F.array().cast("array<string>").alias("out"))

    def step(acc, p):
        nxt = acc["total"] + F.length(p)
        return (F.when(acc["done"] | (nxt > max_chars),
                       F.struct(acc["total"].alias("total"), F.lit(True).alias("done"), acc["out"].alias("out")))
                .otherwise(F.struct(nxt.alias("total"), F.lit(False).alias("done"),
                                    F.array_append(acc["out"], p).alias("out"))))

    return F.aggregate(pieces, init, step, lambda acc: acc["out"])


def ordered_values(structs: Column, field: str) -> Column:
    """A3 helper: sort an array of structs by their leading fields, keep one field."""
    return F.transform(F.array_sort(structs), lambda s: s[field])
