"""Report store and catalogue (report_files), prompts, response status, tree."""

import json
import os
import uuid

from pyspark.sql import functions as F

from citeline.operators import prompts as pr
from citeline.operators import reports as rp
from citeline.operators.tree import tree_json, tree_rollup
from citeline.session import scratch_path


def test_catalogue_newest_20_skips_corrupt(spark):
    path = scratch_path(spark, f"test-reports-{uuid.uuid4().hex}")
    stats = spark.createDataFrame([(f"run{i:02d}", 3, 3, 4, 5, i) for i in range(25)],
                                  "research_id string, personas long, dialogues long, sections long, "
                                  "total_sources long, total_findings long")
    q = spark.createDataFrame([(f"run{i:02d}", "Q" * 150 if i == 24 else f"question {i}") for i in range(25)],
                              "research_id string, question string")
    t = spark.createDataFrame([(f"run{i:02d}", "text") for i in range(25)], "research_id string, report string")
    records = rp.report_records(stats, q, t, generated_at="2026-03-01T10:00:00Z")
    rp.write_reports(records, path)
    rp.write_reports(records.where("research_id >= 'run10'"), path)     # again: nothing changes
    assert rp.read_reports(spark, path).count() == 25
    # one unreadable file and one report without stats
    bad = os.path.join(path, "reports", "bucket=3")
    os.makedirs(bad, exist_ok=True)
    with open(os.path.join(bad, "corrupt.json"), "w") as f:
        f.write("{not json\n")
        f.write(json.dumps({"research_id": "zz", "question": "no stats", "generated_at": "2026-03-02T00:00:00Z"})
                + "\n")
    cat = rp.report_catalogue(spark, path).collect()
    assert len(cat) == 20
    assert (cat[0].file, cat[0].findings) == ("zz", 0)
    assert cat[1].file == "run24" and len(cat[1].question) == 100
    assert [r.file for r in cat[1:]] == [f"run{i:02d}" for i in range(24, 5, -1)]
    assert rp.report_lookup(spark, path, "run03").count() == 1
    assert rp.report_lookup(spark, path, "nope").count() == 0
    assert rp.report_response(rp.report_lookup(spark, path, "run03")).columns == ["question", "report", "stats"]


def test_render_keeps_braces_in_values(spark):
    df = spark.createDataFrame([("T {question} 100%", "h" * 2500)], "topic string, hist string")
    out = df.select(pr.render("journalist_ask", topic=F.col("topic"), persona=F.lit("P"),
                              history=F.col("hist")).alias("p")).first().p
    want = pr.TEMPLATES["journalist_ask"].format(topic="T {question} 100%", persona="P", history="h" * 2000)
    assert out == want


def test_response_status(spark):
    rows = [("a", 0, 429, None, None, None), ("a", 1, 200, "completed", None, "ok text"),
            ("b", 0, 500, None, "boom", None), ("b", 1, 500, None, "boom", None), ("b", 2, 500, None, "boom", None),
            ("c", 0, 200, "error", "Rate limit hit", None), ("c", 1, 429, None, None, None),
            ("c", 2, 200, "error", "quota 429", None),
            ("d", 0, 200, "error", "bad prompt", None), ("d", 1, 200, "error", "bad", None),
            ("d", 2, 200, "error", "still bad", None), ("d", 3, 200, "completed", None, "too late")]
    att = spark.createDataFrame(rows, "prompt_id string, attempt int, http_status int, finished_reason string, "
                                      "error string, text string")
    got = {r.prompt_id: (r.status, r.compat_text) for r in pr.resolve_responses(att).collect()}
    assert got == {"a": ("completed", "ok text"), "b": ("http_error", "[BRIDGE ERROR: HTTP 500]"),
                   "c": ("rate_limited", "[LLM ERROR: max retries exceeded]"),
                   "d": ("error", "[LLM ERROR: still bad]")}


def test_tree(spark):
    nodes = spark.createDataFrame([
        (1, None, "root", [1, 2, 2], "s" * 300), (2, 1, "a", [3], ""), (3, 1, "b", [], None),
        (4, 2, "c", [5, 5, 6], "deep"), (5, None, "other", None, "x")],
        "node_id int, parent_id int, name string, content array<int>, synthesize_output string")
    roll = {r.node_id: (r.depth, r.path, r.content_count, len(r.synthesize)) for r in tree_rollup(nodes).collect()}
    assert roll == {1: (0, "1", 2, 200), 2: (1, "1/2", 1, 0), 3: (1, "1/3", 0, 0), 4: (2, "1/2/4", 2, 4),
                    5: (0, "5", 0, 1)}
    trees = {r.root_id: json.loads(r.tree) for r in tree_json(tree_rollup(nodes)).collect()}
    assert trees[1]["children"][0]["children"][0] == {"name": "c", "content_count": 2, "synthesize": "deep",
                                                      "children": []}
    assert [c["name"] for c in trees[1]["children"]] == ["a", "b"]
    assert trees[5]["children"] == []


def test_deep_chain_cycle_and_orphan(spark):
    n = 10_000
    rows = [(i, i - 1 if i else None, "x", [1, 1], "") for i in range(n)]                     # one chain, 10,000 levels deep
    rows += [(20_000, 20_002, "c", [], ""), (20_001, 20_000, "c", [], ""), (20_002, 20_001, "c", [], ""),
             (20_003, 20_001, "below", None, None), (30_000, 99_999, "orphan", [], ""), (30_001, 30_000, "child", [], "")]
    nodes = spark.createDataFrame(rows, "node_id int, parent_id int, name string, content array<int>, synthesize_output string")
    got = {r.node_id: (r.root_id, r.depth) for r in tree_rollup(nodes, with_path=False).collect()}
    assert all(got[i] == (0, i) for i in range(n))
    assert all(got[i] == (None, None) for i in range(20_000, 20_004))       # a cycle and what hangs on it
    assert got[30_000] == (30_000, 0) and got[30_001] == (30_000, 1)


def test_empty_tree(spark):
    empty = spark.createDataFrame([], "node_id int, parent_id int, name string, content array<int>, synthesize_output string")
    assert tree_rollup(empty).collect() == [] and tree_json(tree_rollup(empty)).collect() == []


def test_report_files_as_written_one_by_one(spark, tmp_path):
    for i in range(23):
        report = {"question": f"é {i} " + "x" * 120, "generated_at": f"2026-02-{i + 1:02d}T00:00:00Z", "stats": {"total_findings": i},
                  "sources": [{"index": 1, "url": "http://u", "title": "t", "description": ""}], "report": "# R\n\ntext"}
        (tmp_path / f"report_202602{i + 1:02d}_000000.json").write_text(json.dumps(report, indent=2, ensure_ascii=False))
    (tmp_path / "report_20260230_000000.json").write_text('{"question": "cut off')
    (tmp_path / "report_20260231_000000.json").write_text("{}")
    (tmp_path / "other.json").write_text("{}")
    got = rp.file_catalogue(spark, str(tmp_path)).collect()
    assert [r.file for r in got] == ["report_20260231_000000.json"] + [f"report_202602{i:02d}_000000.json" for i in range(23, 4, -1)]
    assert (got[0].question, got[0].date, got[0].findings) == ("", "", 0)
    assert got[1].question == ("é 22 " + "x" * 120)[:100] and got[1].findings == 22
    one = rp.file_lookup(spark, str(tmp_path), "report_20260203_000000.json").first()
    assert one.report == "# R\n\ntext" and one.sources[0].url == "http://u"
    assert rp.file_lookup(spark, str(tmp_path), "report_20260230_000000.json").count() == 0
    assert rp.file_lookup(spark, str(tmp_path), "none.json").count() == 0
