"""Queries over the document corpus: paragraphs, main content, context.

Documents are plain text whose paragraphs are separated by single newlines,
so the paragraph pipeline runs with ``sep='\\n'``.  For the source-level
operators a document is a source of the research run named by its
``source`` column, arriving in ``doc_id`` order, titled by its first line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.functions import text as tx
from citeline.operators import paragraphs as para
from citeline.operators.context import compress_context
from citeline.operators.ordering import number_within
from citeline.plans import sqltext as sq
from citeline.plans.registry import query
from citeline.sources.tables import read_table, spread

DOC_SEP = "\n"
CONTENT_MAX = 5000


def load_docs(spark, base, *cols):
    return spread(read_table(spark, base, "documents", *(cols or ("doc_id", "text"))))


def doc_title(text: str = "text"):
    t = F.left(tx.py_strip(F.split(F.col(text), "\n", 2)[0]), F.lit(tx.TITLE_MAX))
    return F.when(t == "", F.lit(tx.UNTITLED)).otherwise(t)


def doc_sources(spark, base, numbered: bool = True):
    """Documents as sources: (research_id, seq, [citation_index,] title, description, content)."""
    d = load_docs(spark, base, "doc_id", "source", "text")
    d = d.select(F.col("source").alias("research_id"), F.col("doc_id").alias("seq"),
                 doc_title().alias("title"), F.lit("").alias("description"), F.col("text").alias("content"))
    return number_within(d, ["research_id"], ["seq"], "citation_index", block_of="seq") if numbered else d


SQL_DOC_TITLE = (f"(CASE WHEN left({sq.strip('split_part(text, chr(10), 1)')}, 300) = '' THEN 'Untitled'"
                 f" ELSE left({sq.strip('split_part(text, chr(10), 1)')}, 300) END)")
SQL_DOC_SOURCES = f"""
SELECT source AS research_id, doc_id AS seq,
       row_number() OVER (PARTITION BY source ORDER BY doc_id) AS citation_index,
       {SQL_DOC_TITLE} AS title, '' AS description, text AS content
FROM documents"""

SQL_TOP = f"""
WITH kept AS ({sq.paragraphs_cte('documents', 'doc_id', 'text', sq.NL)}),
ranked AS (SELECT doc_id, pos, p, {sq.score('p')} AS score,
                  row_number() OVER (PARTITION BY doc_id ORDER BY {sq.score('p')} DESC, pos) AS rnk FROM kept),
top AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY rnk
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM ranked WHERE rnk <= 30)
SELECT doc_id, rnk::BIGINT AS rank, pos::BIGINT AS pos, score::BIGINT AS score,
       left(p, ({CONTENT_MAX} - before)::BIGINT) AS piece
FROM top WHERE before <= {CONTENT_MAX}"""


@query("doc_paragraph_score", f"""
WITH kept AS ({sq.paragraphs_cte('documents', 'doc_id', 'text', sq.NL)})
SELECT doc_id, pos::BIGINT AS pos, {sq.score('p')}::BIGINT AS score, length(p)::BIGINT AS n_chars,
       {sq.words('p')}::BIGINT AS n_words
FROM kept""")
def doc_paragraph_score(spark, base):
    """T8+T9: every paragraph longer than 40 characters with its score."""
    out = para.paragraph_scores(load_docs(spark, base), "doc_id", "text", DOC_SEP)
    return out.select("doc_id", *[F.col(c).cast("long") for c in ("pos", "score", "n_chars", "n_words")])


@query("doc_top_paragraphs", SQL_TOP)
def doc_top_paragraphs(spark, base):
    """T10+B1: best 30 paragraphs per document, cut by the 5000-character budget."""
    out = para.top_paragraphs(load_docs(spark, base), "doc_id", "text", DOC_SEP, CONTENT_MAX)
    return out.select("doc_id", *[F.col(c).cast("long") for c in ("rank", "pos", "score")], "piece")


@query("doc_main_content", f"""
WITH pieces AS ({SQL_TOP})
SELECT d.doc_id, coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY rank), '') AS content
FROM documents d LEFT JOIN pieces p ON d.doc_id = p.doc_id GROUP BY d.doc_id""")
def doc_main_content(spark, base):
    """T12 on plain text: the selected paragraphs joined by blank lines."""
    return para.with_main_content(load_docs(spark, base), "text", "content", DOC_SEP, CONTENT_MAX).drop("text")


@query("context_compress", f"""
WITH src AS ({SQL_DOC_SOURCES}),
blocks AS (SELECT research_id, citation_index,
                  '[' || citation_index || '] ' || title || chr(10) || left(content, 1500) || chr(10) || chr(10) AS block
           FROM src WHERE length(content) > 0),
ctx AS (SELECT research_id, string_agg(block, '' ORDER BY citation_index) AS text FROM blocks GROUP BY research_id),
lines AS (SELECT research_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ctx WHERE length(text) > 8000),
run AS (SELECT *, sum(length(line)) OVER (PARTITION BY research_id ORDER BY i) AS upto FROM lines),
cut AS (SELECT research_id, string_agg(line, chr(10) ORDER BY i) AS context FROM run WHERE upto <= 8000
        GROUP BY research_id)
SELECT research_id, text AS context FROM ctx WHERE length(text) <= 8000
UNION ALL
SELECT c.research_id, coalesce(k.context, '') FROM ctx c LEFT JOIN cut k USING (research_id)
WHERE length(c.text) > 8000""")
def context_compress(spark, base):
    """Compressed context of every run's sources."""
    return compress_context(doc_sources(spark, base, numbered=False))
