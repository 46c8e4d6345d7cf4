"""Tree rollup over the star tables: regions hold nations, nations hold
customers and suppliers, customers hold orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.operators.tree import tree_rollup
from citeline.plans.registry import query
from citeline.sources.tables import read_table


def star_nodes(spark, base):
    """Edge list: a node's content is the year of an order and the month; its synthesis is its own row's text."""
    def level(table, prefix, key, parent_prefix, parent, name, content, text):
        d = read_table(spark, base, table)
        return d.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"),
                        F.concat(F.lit(parent_prefix), F.col(parent).cast("string")).alias("parent_id") if parent
                        else F.lit(None).cast("string").alias("parent_id"),
                        F.col(name).cast("string").alias("name"), content.alias("content"), text.alias("synthesize_output"))

    none, blank = F.lit(None).cast("array<int>"), F.lit("")
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    return (level("region", "r", "r_regionkey", "", None, "r_name", none, blank)
            .unionByName(level("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name", none, F.repeat("n_name", F.lit(60))))
            .unionByName(level("customer", "c", "c_custkey", "n", "c_nationkey", "c_name", none, blank))
            .unionByName(level("supplier", "s", "s_suppkey", "n", "s_nationkey", "s_name", none, blank))
            .unionByName(level("orders", "o", "o_orderkey", "c", "o_custkey", "o_orderkey", F.array(year, month, year), blank)))


SQL_NODES = """
SELECT 'r' || r_regionkey AS id, NULL AS up, r_name::VARCHAR AS name, 0 AS n, '' AS text FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name::VARCHAR, 0, left(repeat(n_name, 60), 200) FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name::VARCHAR, 0, '' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name::VARCHAR, 0, '' FROM supplier
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey::VARCHAR,
                 CASE WHEN year(o_orderdate) = month(o_orderdate) THEN 1 ELSE 2 END, '' FROM orders"""


@query("tree_rollup", f"""
WITH RECURSIVE nodes AS ({SQL_NODES}),
walk(id, root, depth, path) AS (
  SELECT id, id, 0, id FROM nodes r WHERE up IS NULL OR NOT EXISTS (SELECT 1 FROM nodes p WHERE p.id = r.up)
  UNION ALL SELECT n.id, w.root, w.depth + 1, w.path || '/' || n.id FROM nodes n JOIN walk w ON n.up = w.id)
SELECT id AS node_id, up AS parent_id, root AS root_id, depth::INT AS depth, path, name, n::INT AS content_count,
       text AS synthesize
FROM nodes JOIN walk USING (id)""")
def tree_rollup_query(spark, base):
    """A4: root, depth, path and content count of every node."""
    return tree_rollup(star_nodes(spark, base))
