"""Mixing sources to target weights with Pfair windows, in DataFrame functions
only.

Every source's documents, in a hash order, are cut into blocks.  With integer
weights ``a`` that sum to ``W``, block ``k`` of a source (from 0) is released at
slot ``floor(k * W / a)`` and due at ``ceil((k + 1) * W / a)``; in every slot the
released block with the earliest deadline runs.  On one processor this meets all
deadlines, so after any number of slots each source is less than one block away
from its share.

Slots are played in epochs, each on its own: a source has run ``floor(t * a / W)``
blocks at an epoch's first slot ``t``, and one more if its current block is among
the earliest deadlines that fill ``t`` slots, as earliest-deadline-first
leaves it.  Deadlines are met across such a seam too; just before it a block may start
ahead of its release, so there the bound is two blocks instead of one.  The first ``epoch``
slots have no seam.  When the first source has run out, the blocks left follow by deadline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeline.llm.common import materialize, small
from citeline.operators.running import numbered

#: Weights become integers that sum to about this, at least 1 each.
SCALE = 1 << 30
EPOCH = 4096
BUCKET_DIGITS = 3  # hex digits: 4096 numbering buckets per source


def _key(name: str = "source"):
    """Sources with null kept apart from the empty name."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _div(a, b):
    """Integer quotient, exact where a double is not."""
    return F.call_function("div", a, b)


def _release(k, share, total):
    return _div(k * total, share)


def _deadline(k, share, total):
    return _div((k + 1) * total + share - 1, share)


def _counted(df: DataFrame, size: str, out: str, step: int = 1 << 14) -> DataFrame:
    """``df`` with one row per ``out`` from 0 to below ``size``; no row holds more than ``step`` of them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = df.where(F.col(size) > 0)
    for width in (step * step, step):  # the first cut keeps the list of the second short
        top = F.col(size) - 1 if width > step else F.least(F.col(size) - 1, F.col("_from") + step * step - 1)
        start = F.lit(0).cast("long") if width > step else F.col("_from")
        far = far.withColumn("_from", F.explode(F.sequence(start, top, F.lit(width).cast("long"))))
    far = far.repartition(parts, "_from", *[c for c in df.columns if c != size])
    return far.withColumn(out, F.explode(F.sequence("_from", F.least(F.col(size) - 1, F.col("_from") + step - 1)))).drop("_from")


def shares_of(weights: DataFrame) -> DataFrame:
    """``(key, share, total)``: ``weights(key, weight)`` as integers and their sum. Null, NaN,
    infinite and non-positive weights take no part."""
    valid = weights.where("weight > 0 and not isnan(weight) and weight < double('inf')")
    whole = valid.agg(F.sum("weight").alias("_sum"))
    ints = valid.join(F.broadcast(whole)).select(
        "key", F.greatest(F.lit(1), F.round(F.col("weight") / F.col("_sum") * SCALE)).cast("long").alias("share"))
    ints = materialize(ints, "mix-shares")
    return ints.join(F.broadcast(ints.agg(F.sum("share").alias("total"))))


def schedule(shares: DataFrame, slots: int, epoch: int = EPOCH) -> DataFrame:
    """``(key, turn, slot)``: the blocks that run in the first ``slots`` slots for
    ``shares(key, share, total)``. Ties in deadlines go to the smaller key."""
    share, total, t = F.col("share"), F.col("total"), F.col("epoch") * epoch
    at = _counted(shares.withColumn("_n", F.lit(-(-slots // epoch)).cast("long")), "_n", "epoch")
    ran = _div(t * share, total)
    at = at.select("epoch", "key", "share", "total", ran.alias("ran"), (t * share > ran * total).alias("begun"), _deadline(ran, share, total).alias("due"))
    same = Window.partitionBy("epoch")
    ahead = F.col("begun") & (F.row_number().over(same.orderBy(~F.col("begun"), "due", "key")) <= t - F.sum("ran").over(same))
    at = at.withColumn("served", F.col("ran") + F.when(ahead, 1).otherwise(0))
    at = at.withColumn("limit", F.lead("served").over(Window.partitionBy("key").orderBy("epoch")))  # null in the last epoch
    runs = F.coalesce(F.col("served") < F.col("limit"), _release(F.col("served"), share, total) < slots)
    played = (at.where(runs).groupBy("epoch", "total")
              .agg(F.sort_array(F.collect_list(F.struct("key", "share", "served", "limit"))).alias("s")))  # at most ``epoch`` sources run in one

    def step(state, now):
        def offer(source, i):
            k = F.get(state["served"], i)
            late = _release(k, source["share"], total) > now
            return F.when(F.coalesce(k < source["limit"], F.lit(True)), F.struct(
                late.alias("early"), _deadline(k, source["share"], total).alias("due"), i.alias("i")))
        picked = F.transform(F.array(F.array_min(F.transform("s", offer))["i"]), lambda p: F.struct(
            F.transform(state["served"], lambda k, i: F.when(i == p, k + 1).otherwise(k)).alias("served"),
            F.concat(state["order"], F.array(F.struct(p.alias("i"), F.get(state["served"], p).alias("turn")))).alias("order")))
        return F.get(picked, F.lit(0))

    start = F.struct(F.transform("s", lambda x: x["served"]).alias("served"), F.array().cast("array<struct<i:int,turn:bigint>>").alias("order"))
    order = F.aggregate(F.sequence(t, F.least(t + epoch, F.lit(slots).cast("long")) - 1), start, step)["order"]
    return (played.select("s", t.alias("t"), F.posexplode(order).alias("_at", "_o"))
            .select(F.get("s", F.col("_o.i"))["key"].alias("key"), F.col("_o.turn").alias("turn"), (F.col("t") + F.col("_at")).alias("slot")))


def block_slots(sizes: DataFrame, shares: DataFrame, epoch: int = EPOCH) -> tuple[DataFrame, int]:
    """``(key, turn, slot)`` of every block of the sources in ``sizes(key, blocks)`` that have a share, and the
    first slot that a source has no block left for (0 without blocks)."""
    blocks = materialize(sizes.where("blocks > 0").join(shares, "key"), "mix-blocks")
    bound = blocks.agg(F.min(_deadline(F.col("blocks"), F.col("share"), F.col("total")))).first()[0]
    if bound is None:
        return blocks.select("key", F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("slot")), 0
    played = materialize(schedule(shares, bound, epoch), "mix-played").join(blocks.select("key", "blocks"), "key")
    end = played.where("turn >= blocks").agg(F.min("slot")).first()[0]
    first = materialize(played.where(F.col("slot") < end).select("key", "turn", "slot"), "mix-first")
    done = first.groupBy("key").agg(F.count("*").alias("done"))
    rest = (blocks.join(done, "key", "left").withColumn("done", F.coalesce("done", F.lit(0)))
            .withColumn("left", F.col("blocks") - F.col("done")))
    rest = _counted(rest, "left", "j").withColumn("turn", F.col("done") + F.col("j"))
    rest = rest.select("key", "turn", _deadline(F.col("turn"), F.col("share"), F.col("total")).alias("due"))
    rest = numbered(rest, [], ["due", "key"], "place").select("key", "turn", (F.col("place") - 1 + end).alias("slot"))
    return first.unionByName(rest), end


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, block_docs: int = 16) -> DataFrame:
    """``docs`` with the place of every document in the mix:

    * ``mix_block`` - block number within its source, from 0
    * ``mix_slot`` - slot of the block: sorting by it interleaves the sources
    * ``mix_position`` - ``mix_slot * block_docs`` + place in the block
    * ``on_target`` - true before the first source runs out; up to there every
      source is within one block of its weight (two near a seam of epochs).  The
      blocks that remain follow by deadline, so no document is lost.

    ``weights`` maps source names (None for null) to positive numbers; sources
    it does not list keep their rows with null places and ``on_target`` false, and slots
    of a source without documents stay empty.  Without it a source of ``n`` documents weighs
    ``n ** alpha``.  Any number of sources; weights are resolved to ``1 / SCALE`` of
    their sum.  The order within a source is
    by md5 of ``doc_id``; rows of a source that repeat a ``doc_id`` are
    interchangeable.  Input columns named like the added ones are replaced; an
    empty table gives an empty result.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position", "on_target")
    spark = docs.sparkSession
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("*", _key().alias("_key"), mark.alias("_mark"),
                       F.substring(mark, 1, BUCKET_DIGITS).alias("_bucket"))
    sizes = materialize(rows.groupBy("_key", "_bucket").agg(F.count("*").alias("n")), "mix-sizes")
    totals = sizes.groupBy(F.col("_key").alias("key")).agg(F.sum("n").alias("n"))
    if weights is None:
        target = totals.select("key", F.pow(F.col("n").cast("double"), F.lit(float(alpha))).alias("weight"))
    else:
        named = [("" if k is None else f"={k}", float(w)) for k, w in weights.items()]
        target = spark.createDataFrame(named, "key string, weight double")
    blocks = totals.select("key", _div(F.col("n") + block_docs - 1, F.lit(block_docs)).alias("blocks"))
    slots, end = block_slots(blocks, shares_of(target))
    slots = materialize(slots.select(F.col("key").alias("_key"), F.col("turn").alias("_turn"), F.col("slot").alias("_slot")), "mix-slots")

    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_key", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy("_mark", "doc_id")) - 1
    placed = rows.withColumn("_place", place).join(offsets, ["_key", "_bucket"])
    number = F.col("_offset") + F.col("_place")
    placed = (placed.withColumn("_turn", _div(number, F.lit(block_docs))).withColumn("_in", number % block_docs)
              .join(small(slots), ["_key", "_turn"], "left"))
    slot = F.col("_slot")
    return placed.select(*docs.columns, F.when(slot.isNotNull(), F.col("_turn")).alias("mix_block"),
                         slot.alias("mix_slot"), (slot * block_docs + F.col("_in")).alias("mix_position"),
                         F.coalesce(slot < end, F.lit(False)).alias("on_target"))
