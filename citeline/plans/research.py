"""Section relevance and context over the document corpus.

A research run is a document ``source``; its documents are the run's sources in
``doc_id`` arrival order.  The benchmark questions are outline
sections (``item_id`` order) of the run that holds the document with their id.  Sections are written while sources keep
arriving: section ``i`` of ``m`` sees the documents whose id is below
``(i + 1) * (max_doc_id + 1) / (max_item_id + 1)`` — the as-of rule of the
reference, where a section only sees the registry as it stood then.

The stand-in rows reach every branch: every seventh document has no content but
a snippet, and every fifth section a title too short for keywords.

``section_relevance`` takes the whole corpus as one run: every question is a section of it
and scores every document that arrived before.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.operators import relevance as rv
from citeline.plans import sqltext as sq
from citeline.plans.documents import SQL_DOC_TITLE, doc_title
from citeline.plans.registry import query
from citeline.sources.tables import read_table, spread

SNIPPET_CHARS = 700
RUN = "corpus"


def corpus_sources(spark, base):
    d = spread(read_table(spark, base, "documents", "doc_id", "source", "text"))
    return d.select(F.coalesce("source", F.lit("")).alias("research_id"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("step"),
                    doc_title().alias("title"), F.lit("").alias("description"),
                    F.when(F.col("doc_id") % 7 == 3, F.lit("")).otherwise(F.col("text")).alias("content"),
                    F.array(F.left("text", F.lit(SNIPPET_CHARS))).alias("snippets"))


def section_step(questions, docs):
    max_doc = docs.agg(F.max("doc_id")).scalar()
    max_item = questions.agg(F.max("item_id")).scalar()
    return F.floor((F.col("item_id") + 1) * (max_doc + 1) / (max_item + 1)) - 1


def whole_sources(spark, base):
    d = spread(read_table(spark, base, "documents", "doc_id", "text"))
    return d.select(F.lit(RUN).alias("research_id"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("step"),
                    doc_title().alias("title"), F.lit("").alias("description"), F.col("text").alias("content"))


def whole_sections(spark, base):
    b = read_table(spark, base, "benchmark", "item_id", "text")
    step = section_step(b, read_table(spark, base, "documents", "doc_id"))
    return b.select(F.lit(RUN).alias("research_id"), F.col("item_id").alias("sec_id"), step.cast("long").alias("step"),
                    F.col("text").alias("title"))


def corpus_sections(spark, base):
    b = read_table(spark, base, "benchmark", "item_id", "text")
    docs = read_table(spark, base, "documents", "doc_id", "source")
    step = section_step(b, docs)
    title = F.when(F.col("item_id") % 5 == 3, F.left("text", F.lit(rv.KEYWORD_MIN))).otherwise(F.col("text"))
    runs = docs.select(F.col("doc_id").alias("item_id"), F.coalesce("source", F.lit("")).alias("research_id"))
    return b.join(runs, "item_id").select("research_id", F.col("item_id").alias("sec_id"), step.cast("long").alias("step"),
                                          title.alias("title"))


SQL_SECTIONS = f"""
SELECT coalesce(d.source, '') AS research_id, item_id,
       CASE WHEN item_id % 5 = 3 THEN left(b.text, {rv.KEYWORD_MIN}) ELSE b.text END AS title,
       ((item_id + 1) * ((SELECT max(doc_id) FROM documents) + 1)) // ((SELECT max(item_id) FROM benchmark) + 1) - 1
         AS step
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id"""
SQL_SOURCES = f"""
SELECT coalesce(source, '') AS research_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ci,
       {SQL_DOC_TITLE} AS title, CASE WHEN doc_id % 7 = 3 THEN '' ELSE text END AS content,
       left(text, {SNIPPET_CHARS}) AS snippet FROM documents"""
SQL_RELEVANCE = f"""
WITH sec AS ({SQL_SECTIONS}),
kw AS (SELECT research_id, item_id, step, kw, count(*) AS mult
       FROM (SELECT research_id, item_id, step, unnest(regexp_split_to_array({sq.strip('lower(title)')}, {sq.lit(sq.R['ws_run'])})) AS kw
             FROM sec)
       WHERE length(kw) > 3 GROUP BY research_id, item_id, step, kw),
src AS (SELECT research_id, doc_id, lower(content || title || '') AS body FROM ({SQL_SOURCES}))
SELECT kw.item_id AS sec_id, src.doc_id AS seq, sum(mult)::BIGINT AS score
FROM kw JOIN src ON src.research_id = kw.research_id AND src.doc_id <= kw.step AND contains(src.body, kw.kw)
GROUP BY kw.item_id, src.doc_id"""


SQL_WHOLE = f"""
WITH sec AS (SELECT item_id, text AS title,
                    ((item_id + 1) * ((SELECT max(doc_id) FROM documents) + 1)) // ((SELECT max(item_id) FROM benchmark) + 1) - 1 AS step
             FROM benchmark),
kw AS (SELECT item_id, step, kw, count(*) AS mult
       FROM (SELECT item_id, step, unnest(regexp_split_to_array({sq.strip('lower(title)')}, {sq.lit(sq.R['ws_run'])})) AS kw
             FROM sec)
       WHERE length(kw) > 3 GROUP BY item_id, step, kw),
src AS (SELECT doc_id, lower(content || title || '') AS body
        FROM (SELECT doc_id, {SQL_DOC_TITLE} AS title, text AS content FROM documents))
SELECT kw.item_id AS sec_id, src.doc_id AS seq, sum(mult)::BIGINT AS score
FROM kw JOIN src ON src.doc_id <= kw.step AND contains(src.body, kw.kw)
GROUP BY kw.item_id, src.doc_id"""


@query("section_relevance", SQL_WHOLE)
def section_relevance(spark, base):
    """C4+C7+A2: keyword containment score of every visible document per question, over the whole corpus."""
    return rv.section_relevance(whole_sections(spark, base), whole_sources(spark, base)).drop("research_id")


@query("section_context", f"""
WITH sec AS ({SQL_SECTIONS}), s AS ({SQL_SOURCES}), rel AS ({SQL_RELEVANCE}),
top AS (SELECT r.sec_id, s.ci, s.title, CASE WHEN s.content <> '' THEN left(s.content, 1000) ELSE s.snippet END AS snip,
               row_number() OVER (PARTITION BY r.sec_id ORDER BY r.score DESC, r.seq) AS rk
        FROM rel r JOIN s ON s.doc_id = r.seq),
t10 AS (SELECT *, coalesce(sum(length(snip)) OVER (PARTITION BY sec_id ORDER BY rk
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM top WHERE rk <= 10 AND length(snip) > 0),
sel AS (SELECT sec_id, string_agg('[' || ci || '] ' || title || chr(10) || snip || chr(10), chr(10) ORDER BY rk) AS ctx
        FROM t10 WHERE before <= 3000 GROUP BY sec_id),
fb AS (SELECT sec.item_id AS sec_id,
              string_agg('[' || ci || '] ' || s.title || chr(10) || left(content, 500) || chr(10), chr(10) ORDER BY ci) AS ctx
       FROM sec JOIN s ON s.research_id = sec.research_id AND s.ci <= 5 AND s.doc_id <= sec.step AND length(left(s.content, 500)) > 0
       GROUP BY sec.item_id)
SELECT sec.research_id, sec.item_id AS sec_id, coalesce(sel.ctx, fb.ctx, {sq.lit(rv.NO_INFO)}) AS context
FROM sec LEFT JOIN sel ON sel.sec_id = sec.item_id LEFT JOIN fb ON fb.sec_id = sec.item_id""")
def section_context(spark, base):
    """C5+B2+C6+A3: the evidence block handed to the section writer."""
    return rv.section_context(corpus_sections(spark, base), corpus_sources(spark, base))
