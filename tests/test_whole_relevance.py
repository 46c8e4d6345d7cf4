"""Relevance over the whole corpus: every question scores every document that arrived before, of any source."""

import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from citeline.operators import relevance as rv
from citeline.plans.catalog import QUERIES

TEXTS = ["Ocean heat\nthe ocean stores heat", "icecaps melt", "", "Ocean data", None, "reports of oceanic data"]


def test_every_question_meets_every_earlier_document(spark):
    base = tempfile.mkdtemp(prefix="whole-", dir="/tmp")
    docs = [(i, TEXTS[i % len(TEXTS)], f"s{i % 3}") for i in range(40)]
    items = [(i, ["ocean heat ocean", "icecap", "data report of the"][i % 3]) for i in range(45)]      # some without a document of their id
    for name, rows, columns in (("documents", docs, ["doc_id", "text", "source"]), ("benchmark", items, ["item_id", "text"])):
        pq.write_table(pa.table(dict(zip(columns, map(list, zip(*rows))))), os.path.join(base, f"{name}.parquet"))
    want = {}
    for item, question in items:
        for doc, text, _ in docs:
            body = (text or "") + (text or "").split("\n")[0] if text is not None else ""
            score = sum(w in body.lower() for w in question.split() if len(w) > 3)
            if score and doc <= (item + 1) * 40 // 45 - 1:
                want[item, doc] = score
    got = QUERIES["section_relevance"](spark, base).collect()
    assert {(r.sec_id, r.seq): r.score for r in got} == want and len(got) == len(want)


def test_few_and_many_outlines_score_alike(spark, monkeypatch):
    src = spark.createDataFrame([("r", 1, 0, "", "", "the OCEANIC heat"), ("r", 2, None, "", "", "ocean"), ("s", 3, 5, "Icecap", None, None),
                                 (None, 4, 0, "ocean", "", ""), ("t", 5, 0, "ocean", "", "")],
                                "research_id string, seq long, step long, title string, description string, content string")
    sec = spark.createDataFrame([("r", "a", 0, "Ocean ocean heat the"), ("r", "b", None, "ocean"), ("r", "a", 3, "ocean"), ("s", "c", 5, "icecap"),
                                 ("s", "d", 4, "icecap"), (None, "e", 9, "ocean"), ("s", "f", 9, None)],
                                "research_id string, sec_id string, step long, title string")
    few = {asof: sorted(map(tuple, rv.section_relevance(sec, src, asof=asof).collect())) for asof in (True, False)}
    monkeypatch.setattr(rv, "BROADCAST_WORDS", 0)
    many = {asof: sorted(map(tuple, rv.section_relevance(sec, src, asof=asof).collect())) for asof in (True, False)}
    assert few == many
    assert few[True] == [("r", "a", 1, 1), ("r", "a", 1, 3), ("s", "c", 3, 1)] and len(few[False]) == 8
