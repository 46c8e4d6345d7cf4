"""Knowledge-tree rollup (A4) over an edge list.

``nodes``: node_id, parent_id (null for a root), name, content
array<int>, synthesize_output.  Each node reports its name, the number of
distinct content ids, the first 200 characters of its synthesis and its
place in the tree.  Roots and depths come from pointer doubling: every round
each node jumps to its pointer's pointer, so a tree of depth n takes log2(n)
rounds, each one a join and a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.functions.arrays import ordered_values
from citeline.session import written

SYNTH_MAX = 200


def ancestry(nodes: DataFrame, with_path: bool = True) -> DataFrame:
    """(node_id, root_id, depth[, path]) by pointer doubling.

    A node whose parent is null or missing is a root.  Nodes on a cycle, or
    below one, have no root: ``root_id``, ``depth`` and ``path`` are null.  ``path`` lists
    the ids from the root, slash-separated; it is as long as the tree is deep, so leave it out for deep trees."""
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    up = nodes.select("node_id", "parent_id").join(known, "parent_id", "left")
    up = up.select("node_id", F.when(F.col("_known"), F.col("parent_id")).alias("up"))
    state = up.select("node_id", "up", F.coalesce("up", "node_id").alias("top"),
                      F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"),
                      F.col("node_id").cast("string").alias("path"))
    state = written(state if with_path else state.drop("path"), "tree")
    rounds = max(1, state.count()).bit_length()
    for _ in range(rounds):
        if state.where("up is not null").limit(1).count() == 0:
            break
        at = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"),
                          F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if with_path else []))
        jumped = state.where("up is not null").join(at, "up").select(
            "node_id", F.col("_up").alias("up"), F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth"),
            *([F.concat("_path", F.lit("/"), "path").alias("path")] if with_path else []))
        state = written(state.where("up is null").unionByName(jumped), "tree")
    ends = F.col("up").isNull()
    return state.select("node_id", F.when(ends, F.col("top")).alias("root_id"), F.when(ends, F.col("depth")).alias("depth"),
                        *([F.when(ends, F.col("path")).alias("path")] if with_path else []))


def tree_rollup(nodes: DataFrame, with_path: bool = True) -> DataFrame:
    """(node_id, parent_id, root_id, depth[, path], name, content_count, synthesize) per node; see ``ancestry``."""
    walk = ancestry(nodes, with_path)
    return (nodes.join(walk, "node_id")
            .select("node_id", "parent_id", "root_id", F.col("depth").cast("int").alias("depth"), *(["path"] if with_path else []),
                    "name", F.size(F.array_distinct(F.coalesce("content", F.array().cast("array<int>"))))
                    .alias("content_count"),
                    F.left(F.coalesce("synthesize_output", F.lit("")), F.lit(SYNTH_MAX)).alias("synthesize")))


def tree_json(rollup: DataFrame) -> DataFrame:
    """(root_id, tree): each root's nested dict as JSON, children in node_id order."""
    max_depth = rollup.agg(F.max("depth")).first()[0]
    if max_depth is None:       # no tree at all
        return rollup.select("root_id", F.lit("").alias("tree")).where("false")
    body = F.to_json(F.struct("name", "content_count", "synthesize"))

    def node_json(children: F.Column) -> F.Column:
        # '{"name":…,"content_count":…,"synthesize":…,"children":[…]}'
        return F.concat(F.expr("substring(_b, 1, length(_b) - 1)"), F.lit(',"children":['), children, F.lit("]}"))

    below = None
    for d in range(max_depth, -1, -1):
        level = rollup.where(F.col("depth") == d).withColumn("_b", body)
        if below is not None:
            level = level.join(below, F.col("node_id") == F.col("_parent"), "left").drop("_parent")
            kids = F.coalesce(F.col("_kids"), F.lit(""))
        else:
            kids = F.lit("")
        level = level.withColumn("_json", node_json(kids))
        if d == 0:
            return level.select(F.col("root_id"), F.col("_json").alias("tree"))
        below = level.groupBy(F.col("parent_id").alias("_parent")).agg(F.array_join(ordered_values(
            F.collect_list(F.struct(F.col("node_id"), F.col("_json").alias("j"))), "j"), ",").alias("_kids"))
    raise AssertionError("depth 0 ends the loop")
