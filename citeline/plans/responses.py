"""Parsers for generated text, run over the document corpus.

The reference parses text-generator responses (persona lists, query lists,
sub-topic lists, outlines).  Here the same parsers run over every document:
``list_items`` treats each document as a list response; ``outline_sections``
turns each document into a markdown outline whose line ``i`` carries
``(i mod 4) + 1`` leading '#' (so levels 1-3 and the ignored '####' occur).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.operators import parse as ps
from citeline.plans import sqltext as sq
from citeline.plans.registry import query
from citeline.sources.tables import read_table, spread


def _lines_sql(expr="text"):
    return (f"SELECT doc_id, unnest(string_split({expr}, chr(10))) AS line,"
            f" generate_subscripts(string_split({expr}, chr(10)), 1) AS i FROM documents")


_S = sq.strip("line")
_DASH = sq.strip(f"regexp_replace({_S}, '^[- ]+', '')")
_AFTER_DOT = sq.strip(f"regexp_replace({_S}, '^[^.]*[.]', '')")
_NUMBERED = (f"CASE WHEN regexp_matches({_S}, '^\\p{{Nd}}') AND contains(left({_S}, 3), '.')"
             f" THEN {_AFTER_DOT} ELSE {_S} END")


def _kind_sql(kind, item_sql, min_len, limit):
    return (f"SELECT doc_id, '{kind}' AS kind, (r - 1)::BIGINT AS pos, item FROM ("
            f" SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM ("
            f"  SELECT doc_id, i, {item_sql} AS item FROM ({_lines_sql()})) WHERE length(item) > {min_len})"
            f" WHERE r <= {limit}")


SQL_LIST_ITEMS = f"""
WITH p AS ({_kind_sql('persona', _NUMBERED, ps.PERSONA_MIN, ps.PERSONAS)})
SELECT * FROM p
UNION ALL SELECT doc_id, 'persona', 0::BIGINT, {sq.lit(ps.DEFAULT_PERSONA)} FROM documents
          WHERE doc_id NOT IN (SELECT doc_id FROM p)
UNION ALL {_kind_sql('query', _DASH, ps.QUERY_MIN, ps.QUERIES)}
UNION ALL {_kind_sql('subtopic', _DASH, ps.SUBTOPIC_MIN, ps.SUBTOPICS)}"""


@query("list_items", SQL_LIST_ITEMS)
def list_items(spark, base):
    """L2-L4: persona, query and sub-topic lists parsed from every document."""
    d = spread(read_table(spark, base, "documents", "doc_id", "text"))
    # strip every line once; the three parsers read the stripped lines
    d = d.select("doc_id", "text", ps.stripped_lines(F.col("text")).alias("lines"))
    t, lines = F.col("text"), F.col("lines")
    kinds = F.array(
        F.struct(F.lit("persona").alias("kind"), ps.persona_items(t, lines=lines).alias("items")),
        F.struct(F.lit("query").alias("kind"), ps.query_items(t, lines).alias("items")),
        F.struct(F.lit("subtopic").alias("kind"), ps.subtopic_items(t, lines).alias("items")))
    return (d.select("doc_id", F.explode(kinds).alias("k"))
            .select("doc_id", "k.kind", F.posexplode("k.items").alias("pos", "item"))
            .withColumn("pos", F.col("pos").cast("long")))


def outline_text(text="text"):
    lines = F.split(F.col(text), "\n", -1)
    marked = F.transform(lines, lambda l, i: F.concat(F.repeat(F.lit("#"), i % 4 + 1), F.lit(" "), l))
    return F.array_join(marked, "\n")


_H = sq.strip("repeat('#', ((i - 1) % 4 + 1)::INTEGER) || ' ' || line")
_OUT = sq.lit(ps.OUTLINE_LINE)


@query("outline_sections", f"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS sec_no,
       length(regexp_extract(h, {_OUT}, 1))::BIGINT AS level,
       {sq.strip(f'regexp_extract(h, {_OUT}, 2)')} AS title
FROM (SELECT doc_id, i, {_H} AS h FROM ({_lines_sql()})) WHERE regexp_matches(h, {_OUT})""")
def outline_sections(spark, base):
    """Outline sections parsed from each document rendered as markdown."""
    d = spread(read_table(spark, base, "documents", "doc_id", "text"))
    return ps.outline_sections(d.select("doc_id", outline_text().alias("outline")), ["doc_id"], "outline")
