"""A whole research run from generator tables and a page corpus."""

from citeline.plans.runs import research_tables


def test_two_runs_end_to_end(spark):
    html = {
        "http://a": "<title>Ocean heat</title><p>" + "ocean heat content rises " * 5 + "</p>",
        "http://b": "<title>Ice</title><p>" + "ice sheets melt quickly " * 5 + "</p>",
        "http://c": "<title>Heat waves</title><p>" + "heat waves in cities " * 5 + "</p>",
    }
    corpus = spark.createDataFrame(list(html.items()), "url string, html string")
    questions = spark.createDataFrame([("q1", "Ocean warming?"), ("q2", "Ice loss?")], "research_id string, question string")
    personas = spark.createDataFrame([("q1", "1. Expert en climat: oceans\n2. Expert en glace: calottes"),
                                      ("q2", "none")], "research_id string, text string")
    turns = spark.createDataFrame([
        ("q1", 0, 1, "Q?", "The ocean stores most of the extra heat. Short. Sea levels rise as water warms up."),
        ("q2", 0, 1, "Q?", "Ice sheets are losing mass every single year.")],
        "research_id string, persona_no int, turn_no long, question string, answer string")
    search = spark.createDataFrame([
        ("q1", 0, 1, 0, "- http://a\n- http://missing"),
        ("q1", 0, 1, 1, "- http://a\n- http://b"),           # a again: first seen wins
        ("q1", 0, 1, 2, "- http://c"),                       # third query: not searched
        ("q1", 2, 0, 0, "- http://c"),                       # found while writing section 2
        ("q2", 0, 1, 0, "- http://b")],
        "research_id string, step int, turn_no long, query_no int, text string")
    outline = spark.createDataFrame([("q1", "# Ocean heat\n## Heat waves\n### Unrelated topic"),
                                     ("q2", "# Ice")], "research_id string, text string")
    t = research_tables(personas, turns, search, outline, corpus, questions)

    src = {(r.research_id, r.citation_index): r.url for r in t["sources"].collect()}
    assert src == {("q1", 1): "http://a", ("q1", 2): "http://b", ("q1", 3): "http://c", ("q2", 1): "http://b"}
    ctx = {(r.research_id, r.sec_id): r.context for r in t["context"].collect()}
    assert ctx[("q1", 1)].startswith("[1] Ocean heat")          # 'heat' and 'ocean' match source 1
    assert "[3] Heat waves" not in ctx[("q1", 1)]                # c arrives with section 2: not visible yet
    assert ctx[("q1", 2)].startswith("[3] Heat waves")           # visible to section 2, best score
    stats = {r.research_id: (r.personas, r.sections, r.total_sources, r.total_findings)
             for r in t["stats"].collect()}
    assert stats == {"q1": (2, 3, 3, 2), "q2": (1, 1, 1, 1)}
    rep = {r.research_id: r for r in t["reports"].collect()}
    assert rep["q1"].question == "Ocean warming?" and rep["q1"].stats.total_sources == 3
    assert rep["q1"].report.split("\n")[0] == "- The ocean stores most of the extra heat"
