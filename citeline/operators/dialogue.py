"""Dialogue operators over a turn table.

Input: one row per utterance ``(conv, turn, role, text)`` with consecutive
turn numbers.  A question is a user utterance, its answer the assistant
utterance of the next turn.

Scale: pairing is an equi-join on ``(conv, turn)`` — a unique key, so a
conversation with billions of turns still spreads over all tasks.  The
stop-phrase cut is a partial aggregation (first stop per conversation).
Only after the ``max_turns`` limit (a partial group top-k) do windows run,
over at most ``max_turns`` rows per conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeline.functions import text as tx
from citeline.functions.arrays import ordered_values

# Prefixes of a question that ends the interview (case-sensitive).
STOP_PREFIXES = ("Merci", "Thank")
MAX_TURNS = 2
HISTORY_CHARS = 2000
FINDING_SPLIT = "[.!?]" + tx.WS + "+"
FINDING_PIECES = 3
FINDING_MIN = 20


def is_stop(q) -> "F.Column":
    cond = F.lit(False)
    for p in STOP_PREFIXES:
        cond = cond | q.startswith(p)
    return cond


def assemble_turns(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", max_turns: int = MAX_TURNS) -> DataFrame:
    """D1 + L6: (key, turn_no, turn, question, answer) for the dialogue turns.

    Questions are stripped user utterances; a dialogue ends at the first
    question starting with a stop phrase (that question excluded), and keeps
    at most ``max_turns`` answered questions.  A question is answered by the
    conversation's next utterance if that is the assistant's; turn numbers may have gaps.
    """
    follows = Window.partitionBy(key).orderBy(turn)
    said = conv.select(key, turn, role, text, F.lead(role).over(follows).alias("_role"), F.lead(text).over(follows).alias("answer"))
    users = said.where(F.col(role) == "user").withColumn("question", tx.py_strip(F.col(text)))
    stops = (users.where(is_stop(F.col("question")))
             .groupBy(key).agg(F.min(turn).alias("_stop")))
    pairs = (users.where(F.col("_role") == "assistant").join(stops, key, "left")
             .where(F.col("_stop").isNull() | (F.col(turn) < F.col("_stop"))))
    w = Window.partitionBy(key).orderBy(turn)
    return (pairs.withColumn("turn_no", F.row_number().over(w).cast("long"))
            .where(F.col("turn_no") <= max_turns)
            .select(key, "turn_no", turn, "question", "answer"))


def history_piece(q="question", a="answer"):
    return F.concat(F.lit("\nQ: "), F.coalesce(q, F.lit("")), F.lit("\nR: "), F.coalesce(a, F.lit("")), F.lit("\n"))


def with_history(turns: DataFrame, key: str = "conv_id", order: str = "turn_no",
                 chars: int = HISTORY_CHARS) -> DataFrame:
    """The interview history seen when asking each question: the previous
    turns as ``\\nQ: …\\nR: …\\n``, last ``chars`` characters; null texts are empty.

    A running total of the pieces' lengths tells where each piece ends; the frame of
    a turn reaches back over the pieces that end within the last ``chars`` characters, and no further."""
    by = Window.partitionBy(key).orderBy(order)
    size = F.length(history_piece())
    start = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)) - size
    placed = turns.withColumn("_start", start).withColumn("_before", F.lag(history_piece()).over(by))
    reach = Window.partitionBy(key).orderBy("_start").rangeBetween(1 - chars, 0)
    pieces = F.collect_list(F.when(F.col("_before").isNotNull(), F.struct("_start", F.col("_before").alias("p")))).over(reach)
    return (placed.withColumn("history", F.right(F.array_join(ordered_values(pieces, "p"), ""), F.lit(chars)))
            .drop("_start", "_before"))


def findings(turns: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """D3: up to three findings per answer: first three sentence pieces, those
    longer than 20 characters, stripped.  Narrow: no shuffle."""
    pieces = F.slice(F.split(F.col(answer), FINDING_SPLIT, -1), 1, FINDING_PIECES)
    return (turns.where(F.length(F.col(answer)) > 0)
            .select(*keys, F.posexplode(pieces).alias("pos", "piece"))
            .where(F.length("piece") > FINDING_MIN)
            .select(*keys, F.col("pos").cast("long").alias("pos"), tx.py_strip(F.col("piece")).alias("finding")))


def first_findings(found: DataFrame, run: str, order: list[str], n: int, out: str,
                   max_chars: int | None = None) -> DataFrame:
    """The first ``n`` findings of a run as ``- finding`` lines."""
    w = Window.partitionBy(run).orderBy(*order)
    top = found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    line = F.concat(F.lit("- "), F.col("finding"))
    text = F.array_join(ordered_values(F.collect_list(F.struct(F.col("_k"), line.alias("l"))), "l"), "\n")
    if max_chars is not None:
        text = F.left(text, F.lit(max_chars))
    return top.groupBy(run).agg(text.alias(out))
