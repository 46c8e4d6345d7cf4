"""Queries over the conversation table: interview turns, history, findings.

Each conversation is one persona's interview; three consecutive
conversations form one research run (the reference interviews three
personas per question): ``research_id = conv_id div 3``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeline.operators import dialogue as dl
from citeline.plans import sqltext as sq
from citeline.plans.registry import query
from citeline.sources.tables import read_table

PERSONAS_PER_RUN = 3
OUTLINE_FINDINGS, SUBTOPIC_FINDINGS, SUBTOPIC_CHARS = 10, 5, 1500


def load_conv(spark, base):
    return read_table(spark, base, "conversations", "conv_id", "turn", "role", "text")


def turns(spark, base):
    return dl.assemble_turns(load_conv(spark, base))


def run_findings(spark, base):
    f = dl.findings(turns(spark, base), ["conv_id", "turn_no"])
    return f.withColumn("research_id", F.expr(f"conv_id div {PERSONAS_PER_RUN}"))


_SPLIT = sq.lit("[.!?]" + sq.R["ws_run"])
_STOP = " OR ".join(f"starts_with(question, {sq.lit(p)})" for p in dl.STOP_PREFIXES)
SQL_TURNS = f"""
SELECT conv_id, turn_no::BIGINT AS turn_no, turn, question, answer FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM (
    SELECT * FROM (
      SELECT conv_id, turn, question, next_role, next_text AS answer,
             bool_or({_STOP}) OVER (PARTITION BY conv_id ORDER BY turn
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
      FROM (SELECT conv_id, turn, role, {sq.strip('text')} AS question,
                   lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                   lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
            FROM conversations) c
      WHERE role = 'user')
    WHERE NOT stopped AND next_role = 'assistant'))
WHERE turn_no <= {dl.MAX_TURNS}"""

SQL_FINDINGS = f"""
WITH t AS ({SQL_TURNS}),
s AS (SELECT conv_id, turn_no,
             unnest(list_slice(regexp_split_to_array(answer, {_SPLIT}), 1, 3)) AS piece,
             generate_subscripts(list_slice(regexp_split_to_array(answer, {_SPLIT}), 1, 3), 1) - 1 AS pos
      FROM t WHERE length(answer) > 0)
SELECT conv_id, turn_no, pos::BIGINT AS pos, {sq.strip('piece')} AS finding FROM s WHERE length(piece) > 20"""


@query("conv_turns", SQL_TURNS)
def conv_turns(spark, base):
    """D1 + L6: answered questions per interview, cut at a stop phrase, at most two."""
    return turns(spark, base)


STOPPED = "CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN '  Merci, ' || text ELSE text END"


@query("conv_turns_stopped", SQL_TURNS.replace(
    "FROM conversations)", f"FROM (SELECT conv_id, turn, role, {STOPPED} AS text FROM conversations))"))
def conv_turns_stopped(spark, base):
    """L6 where questions do open with a stop phrase: stand-in interviews in which a fifth of
    the questions thank."""
    thanked = (F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    text = F.when(thanked, F.concat(F.lit("  Merci, "), "text")).otherwise(F.col("text"))
    return dl.assemble_turns(load_conv(spark, base).withColumn("text", text))


@query("conv_history", f"""
WITH t AS ({SQL_TURNS}),
h AS (SELECT t.conv_id, t.turn_no,
             coalesce(string_agg(chr(10) || 'Q: ' || p.question || chr(10) || 'R: ' || p.answer || chr(10), ''
                                 ORDER BY p.turn_no), '') AS hist
      FROM t LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn_no < t.turn_no
      GROUP BY t.conv_id, t.turn_no)
SELECT conv_id, turn_no, right(hist, {dl.HISTORY_CHARS}) AS history FROM h""")
def conv_history(spark, base):
    """The history shown to the interviewer before each question."""
    return dl.with_history(turns(spark, base)).select("conv_id", "turn_no", "history")


def long_turns(spark, base):
    """Stand-in for long interviews: every answered question, answers said three times."""
    t = dl.assemble_turns(load_conv(spark, base), max_turns=1 << 30)
    return t.select("conv_id", "turn_no", "question", F.repeat("answer", F.lit(3)).alias("answer"))


@query("conv_history_long", f"""
WITH t AS (SELECT conv_id, turn_no, question, repeat(answer, 3) AS answer
           FROM ({SQL_TURNS.replace(f"WHERE turn_no <= {dl.MAX_TURNS}", "")})),
h AS (SELECT t.conv_id, t.turn_no,
             coalesce(string_agg(chr(10) || 'Q: ' || p.question || chr(10) || 'R: ' || p.answer || chr(10), ''
                                 ORDER BY p.turn_no), '') AS hist
      FROM t LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn_no < t.turn_no
      GROUP BY t.conv_id, t.turn_no)
SELECT conv_id, turn_no, right(hist, {dl.HISTORY_CHARS}) AS history, length(hist)::BIGINT > {dl.HISTORY_CHARS} AS cut FROM h""")
def conv_history_long(spark, base):
    """D2 where the 2000 characters do not hold all earlier turns."""
    turns = long_turns(spark, base)
    piece = F.length(dl.history_piece())
    before = F.coalesce(F.sum(piece).over(Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (dl.with_history(turns.withColumn("cut", before > dl.HISTORY_CHARS))
            .select("conv_id", "turn_no", "history", "cut"))


@query("conv_findings", SQL_FINDINGS)
def conv_findings(spark, base):
    """D3: findings extracted from the answers."""
    return dl.findings(turns(spark, base), ["conv_id", "turn_no"])


@query("finding_summary", f"""
WITH f AS (SELECT *, conv_id // {PERSONAS_PER_RUN} AS research_id,
                  row_number() OVER (PARTITION BY conv_id // {PERSONAS_PER_RUN} ORDER BY conv_id, turn_no, pos) AS k
           FROM ({SQL_FINDINGS})),
runs AS (SELECT DISTINCT conv_id // {PERSONAS_PER_RUN} AS research_id FROM conversations)
SELECT r.research_id,
       coalesce((SELECT string_agg('- ' || finding, chr(10) ORDER BY k) FROM f
                 WHERE f.research_id = r.research_id AND k <= {OUTLINE_FINDINGS}), '') AS outline_findings,
       coalesce((SELECT left(string_agg('- ' || finding, chr(10) ORDER BY k), {SUBTOPIC_CHARS}) FROM f
                 WHERE f.research_id = r.research_id AND k <= {SUBTOPIC_FINDINGS}), '') AS subtopic_findings
FROM runs r""")
def finding_summary(spark, base):
    """First 10 findings (outline prompt) and first 5 (sub-topic prompt) per run."""
    f = run_findings(spark, base)
    order = ["conv_id", "turn_no", "pos"]
    ten = dl.first_findings(f, "research_id", order, OUTLINE_FINDINGS, "outline_findings")
    five = dl.first_findings(f, "research_id", order, SUBTOPIC_FINDINGS, "subtopic_findings", SUBTOPIC_CHARS)
    runs = load_conv(spark, base).select(F.expr(f"conv_id div {PERSONAS_PER_RUN}").alias("research_id")).distinct()
    return (runs.join(ten, "research_id", "left").join(five, "research_id", "left")
            .select("research_id", F.coalesce("outline_findings", F.lit("")).alias("outline_findings"),
                    F.coalesce("subtopic_findings", F.lit("")).alias("subtopic_findings")))
