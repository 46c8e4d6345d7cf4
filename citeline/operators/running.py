"""Numbers and running totals per group that no single task has to count.

A window over a group sorts the whole group in one task.  Here rows are
range-partitioned by (group, order), so a huge group spreads over as many
partitions as it needs; each partition counts its own stretch, and the
totals of a group's earlier stretches (one row per partition and group) are
added.  The sorted rows are written once in between, as their place in the
files decides the numbers.

Range partitioning samples its input first, which evaluates it a second
time: hand in the key, order and amount columns of a table, and join wide columns afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.session import written

_PART, _ROW = "_part", "_row"


def _stretches(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    by = [*keys, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ranged.select("*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().alias(_ROW)), "stretches")


def _with_offsets(rows: DataFrame, keys: Sequence[str], per_stretch: Mapping[str, Column], sums: Sequence[str]) -> DataFrame:
    """``rows`` joined with their stretch's aggregates; those in ``sums`` become
    the totals of the group's earlier stretches (null keys are a group too)."""
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.groupBy(_PART, *keys).agg(*[c.alias(n) for n, c in per_stretch.items()])
    totals = cut.select(F.col(_PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) if n in sums else F.col(n) for n in per_stretch])
    on = F.col(_PART) == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(totals, on).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Add ``out``: the row's place from 1 in its group by ``order`` (any sort
    columns; rows that tie in all of them are numbered in some order)."""
    rows = _stretches(df.drop(out), keys, order)
    per = {"_first": F.min(_ROW), "_before": F.count(F.lit(1))}
    joined = _with_offsets(rows, keys, per, ["_before"])
    number = (F.col(_ROW) - F.col("_first") + F.col("_before") + 1).alias(out)
    return joined.select(*[c for c in df.columns if c != out], number)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], totals: Mapping[str, Column | str]) -> DataFrame:
    """Add, per entry of ``totals``, the sum of its column over the group's rows
    up to and including this one.  Null amounts count as 0."""
    amounts = {f"_a{i}": c for i, c in enumerate(totals.values())}
    kept = [c for c in df.columns if c not in totals]
    named = df.select(*kept, *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).alias(n) for n, c in amounts.items()])
    rows = _stretches(named, keys, order)
    here = Window.partitionBy(_PART, *keys).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    per = {f"{n}_before": F.sum(n) for n in amounts}
    joined = _with_offsets(rows, keys, per, list(per))
    return joined.select(*kept, *[(F.sum(n).over(here) + F.col(f"{n}_before")).alias(out) for n, out in zip(amounts, totals)])


def carried_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str) -> DataFrame:
    """``df`` with nulls of ``value`` replaced by the group's last value before them in
    ``order`` (null if there is none).  A stretch hands its last value on to the later ones."""
    rows = _stretches(df, keys, order)
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.groupBy(_PART, *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(_ROW))).alias("_last"))
    entering = cut.select(F.col(_PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                          F.last("_last", ignorenulls=True).over(earlier).alias("_entering")).where("_entering is not null")
    on = F.col(_PART) == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = Window.partitionBy(_PART, *keys).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(here), F.col("_entering")).alias(value)
    return rows.join(entering, on, "left").select(*[filled if c == value else F.col(c) for c in df.columns])
