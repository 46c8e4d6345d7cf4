"""Run statistics, report store round trip, prompts and section drafts.

Runs are the conversation runs of ``plans.conversations`` (three personas
per run).  The outline and source counts come from running the outline
parser and the URL extractor over the run's answers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeline.operators import parse as ps
from citeline.operators import prompts as pr
from citeline.operators import relevance as rv
from citeline.operators import reports as rp
from citeline.operators import urls as ur
from citeline.plans import conversations as cv
from citeline.plans import research as rs
from citeline.plans import sqltext as sq
from citeline.plans.registry import ORACLE, query
from citeline.session import scratch_path


def generated_at(run: str = "research_id"):
    """Stand-in time of a run's report: the runs are spread over a month."""
    return F.concat(F.lit("2026-01-"), F.lpad((F.col(run) * 11 % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))


SQL_GENERATED = "'2026-01-' || lpad((s.research_id * 11 % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z'"
SECTIONS_MAX = 8000


def _run_col():
    return F.expr(f"conv_id div {cv.PERSONAS_PER_RUN}").alias("research_id")


def stats(spark, base):
    conv = cv.load_conv(spark, base)
    turns = cv.turns(spark, base).withColumn("research_id", F.expr(f"conv_id div {cv.PERSONAS_PER_RUN}"))
    personas = conv.select("conv_id", _run_col()).distinct()
    secs = ps.outline_sections(turns, ["research_id", "conv_id", "turn_no"], "answer")
    urls = (turns.select("research_id", F.explode(ur.extract_urls(F.col("answer"))).alias("url"))
            .distinct())
    return rp.run_stats(conv.select(_run_col()), "research_id", personas=personas, dialogues=personas,
                        sections=secs, total_sources=urls, total_findings=cv.run_findings(spark, base))


def questions(spark, base):
    t = cv.turns(spark, base).withColumn("research_id", F.expr(f"conv_id div {cv.PERSONAS_PER_RUN}"))
    return t.groupBy("research_id").agg(
        F.min_by("question", F.struct("conv_id", "turn_no")).alias("question"))


_RUN = f"conv_id // {cv.PERSONAS_PER_RUN}"
_OUT = sq.lit(ps.OUTLINE_LINE)
SQL_STATS = f"""
WITH t AS ({cv.SQL_TURNS}),
lines AS (SELECT {_RUN} AS r, {sq.strip('unnest(string_split(answer, chr(10)))')} AS l FROM t),
urls AS (SELECT DISTINCT {_RUN} AS r, regexp_replace(unnest(regexp_extract_all(answer, {sq.lit(sq.R['url'])})),
                                                     '[.,;:]+$', '') AS u FROM t),
f AS ({cv.SQL_FINDINGS})
SELECT r AS research_id,
       count(DISTINCT conv_id)::BIGINT AS personas, count(DISTINCT conv_id)::BIGINT AS dialogues,
       (SELECT count(*) FROM lines WHERE lines.r = c.r AND regexp_matches(l, {_OUT}))::BIGINT AS sections,
       (SELECT count(*) FROM urls WHERE urls.r = c.r)::BIGINT AS total_sources,
       (SELECT count(*) FROM f WHERE {_RUN} = c.r)::BIGINT AS total_findings
FROM (SELECT conv_id, {_RUN} AS r FROM conversations) c GROUP BY r"""


@query("run_stats", SQL_STATS)
def run_stats(spark, base):
    """A1: personas, dialogues, sections, sources and findings per run."""
    return stats(spark, base)


@query("report_catalogue", f"""
WITH s AS ({SQL_STATS}),
q AS (SELECT {_RUN} AS research_id, arg_min(question, (conv_id, turn_no)) AS question
      FROM ({cv.SQL_TURNS}) GROUP BY {_RUN})
SELECT s.research_id::VARCHAR AS file, left(coalesce(q.question, ''), 100) AS question, {SQL_GENERATED} AS date,
       s.total_findings AS findings
FROM s LEFT JOIN q USING (research_id)
ORDER BY date DESC, file DESC LIMIT 20""")
def report_catalogue(spark, base):
    """RPT + S9 + S10: build every run's report, append it to the report
    store, read the store back and list the newest 20."""
    st = stats(spark, base)
    texts = cv.finding_summary(spark, base).select("research_id", F.col("outline_findings").alias("report"))
    reports = rp.report_records(st, questions(spark, base), texts, generated_at=generated_at())
    path = scratch_path(spark, f"reports-{uuid.uuid4().hex}")
    rp.write_reports(reports, path)
    rp.write_reports(reports.where("pmod(xxhash64(research_id), 2) = 0"), path)     # a re-run replaces its own reports
    return rp.report_catalogue(spark, path)


@query("run_prompts", f"""
WITH q AS (SELECT {_RUN} AS research_id, arg_min(question, (conv_id, turn_no)) AS question
           FROM ({cv.SQL_TURNS}) GROUP BY {_RUN}),
runs AS (SELECT DISTINCT {_RUN} AS research_id FROM conversations),
f AS (SELECT research_id, subtopic_findings FROM ({ORACLE['finding_summary']}))
SELECT runs.research_id,
       replace({sq.lit(pr.TEMPLATES['draft_outline'])}, '{{topic}}', coalesce(q.question, '')) AS draft_outline,
       replace(replace({sq.lit(pr.TEMPLATES['expand_subtopics'])}, '{{findings}}', left(f.subtopic_findings, 1500)),
               '{{topic}}', coalesce(q.question, '')) AS expand_subtopics
FROM runs LEFT JOIN q USING (research_id) LEFT JOIN f USING (research_id)""")
def run_prompts(spark, base):
    """L1 + C13: outline and sub-topic prompts of every run."""
    runs = cv.load_conv(spark, base).select(_run_col()).distinct()
    f = cv.finding_summary(spark, base).select("research_id", "subtopic_findings")
    d = runs.join(questions(spark, base), "research_id", "left").join(f, "research_id", "left")
    return d.select("research_id",
                    pr.render("draft_outline", topic=F.col("question")).alias("draft_outline"),
                    pr.render("expand_subtopics", topic=F.col("question"),
                              findings=F.col("subtopic_findings")).alias("expand_subtopics"))


@query("section_drafts", f"""
WITH ctx AS ({ORACLE['section_context']}), sec AS ({rs.SQL_SECTIONS})
SELECT sec.research_id, left(string_agg('## ' || sec.title || chr(10) || chr(10) || ctx.context, chr(10) || chr(10)
                       ORDER BY sec.item_id), {SECTIONS_MAX}) AS sections_text
FROM sec JOIN ctx ON ctx.sec_id = sec.item_id GROUP BY sec.research_id""")
def section_drafts(spark, base):
    """SEC + A3 + C13: every run's sections assembled in outline order, cut to the 8000
    characters handed to the synthesis prompt."""
    secs = rs.corpus_sections(spark, base)
    d = secs.join(rv.section_context(secs, rs.corpus_sources(spark, base)), ["research_id", "sec_id"])
    return rv.assemble_sections(d, "research_id", "sec_id", "title", "context", SECTIONS_MAX)
