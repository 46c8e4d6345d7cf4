"""Ordering primitives that stay parallel when one group is huge.

* ``number_within`` — dense 1..n numbering per group (C2 citation numbers,
  C3 local numbers).  A plain ``row_number`` window sends a whole group to
  one task; here a group ordered by one integral column is cut into id ranges, whose sizes are
  counted with a partial aggregation and whose rows are numbered on their own.  Any
  other order is numbered over range partitions (``running.numbered``).
* ``first_seen`` — first row per key by an order (U3, S4): a partial
  aggregation with ``min_by``, so a hot key is combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.operators.running import numbered

DEFAULT_BLOCK = 1 << 16


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
                  block_of: str | None = None, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out`` = 1-based position of each row within ``keys`` by ``order``.

    ``order`` must be a total order within a group.  ``block_of`` names the order
    column if it is the only one and integral: its values are cut into ranges of ``block_size``.
    """
    keys, order = list(keys), list(order)
    if block_of is None or order != [block_of]:
        return numbered(df, keys, order, out)
    blk = "_blk"
    d = df.withColumn(blk, F.floor(F.col(block_of) / F.lit(block_size)))
    bkeys = [*keys, blk]
    sizes = d.groupBy(*bkeys).agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*bkeys, F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*bkeys).orderBy(*order)
    return (d.join(offsets, bkeys)
            .withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("long"))
            .drop(blk, "_off"))


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of every ``keys`` group by ``order`` (ties: any)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordkey = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(F.min_by(row, ordkey).alias("_r"))
            .select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, out: str = "_rank",
            block_of: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group (rank column ``out`` kept).

    While Spark's group limit applies (``windowGroupLimitThreshold``), every task
    sends at most ``n`` rows of a group; beyond it groups are numbered in parallel and filtered."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n <= limit or block_of is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= n)
    return number_within(df, keys, order, out, block_of=block_of).where(F.col(out) <= n)
