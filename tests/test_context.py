"""Context compressor (B3) and result formatting."""

from citeline.operators.context import compress_context, deep_dive, format_results


def sources(spark, rows):
    return spark.createDataFrame(rows, "research_id string, citation_index long, title string, content string")


def test_compress_short_context_unchanged(spark):
    df = sources(spark, [("r", 1, "T1", "abc"), ("r", 2, "T2", ""), ("r", 3, "T3", "x\ny")])
    got = compress_context(df).first().context
    assert got == "[1] T1\nabc\n\n[3] T3\nx\ny\n\n"


def test_compress_cuts_whole_lines(spark):
    # three blocks of 1500 chars each: 3 * (1500 + header) > 4000
    df = sources(spark, [("r", i, "t", "z" * 1500) for i in range(1, 4)])
    got = compress_context(df, max_chars=4000).first().context
    lines = got.split("\n")
    assert lines == ["[1] t", "z" * 1500, "", "[2] t", "z" * 1500, "", "[3] t"]
    assert sum(len(x) for x in lines) <= 4000


def test_compress_hot_run_gathers_bounded_prefix(spark):
    n = 5000
    df = sources(spark, [("hot", i, "", "c" * 10) for i in range(1, n + 1)])
    got = compress_context(df, max_chars=8000).first().context
    assert sum(len(x) for x in got.split("\n")) <= 8000
    assert got.startswith("[1] \ncccccccccc\n\n[2] ")


def test_format_results_local_numbers(spark):
    rows = [("q", s, f"T{s}", f"http://u/{s}", "s" * 600) for s in (30, 10, 20, 40, 50, 60)]
    df = spark.createDataFrame(rows, "research_id string, seq long, title string, url string, snippet string")
    got = format_results(df, ["research_id"], ["seq"]).first().results_text
    parts = got.split("\n[")
    assert len(parts) == 5
    assert got.startswith("[1] T10\nURL: http://u/10\n" + "s" * 500 + "\n")


def test_format_results_citation_map(spark):
    rows = [("q", s, f"T{s}", f"http://u/{s}", "x", 100 + s) for s in (3, 1, 2)]
    df = spark.createDataFrame(rows, "research_id string, seq long, title string, url string, snippet string, "
                                     "ci long")
    got = format_results(df, ["research_id"], ["seq"], citation="ci").first().citations
    assert [(c.local, c.citation_index) for c in got] == [(1, 101), (2, 102), (3, 103)]


def test_deep_dive(spark):
    subs = spark.createDataFrame([("r", "- premier sous-theme long\n- x\n- second sous-theme long\n"
                                        "- troisieme sous-theme\n- quatrieme sous-theme")],
                                 "research_id string, text string")
    res = spark.createDataFrame([("r", 0, 1, "A", "http://a", "aa"), ("r", 1, 1, "B", "http://b", "bb")],
                                "research_id string, sub_no int, seq long, title string, url string, snippet string")
    rows = deep_dive(subs, res).orderBy("sub_no").collect()
    assert [r.subtopic for r in rows] == ["premier sous-theme long", "second sous-theme long", "troisieme sous-theme"]
    assert rows[0].section_title == "Exploration approfondie: premier sous-theme long"
    assert rows[1].info == "[1] B\nURL: http://b\nbb\n" and rows[2].info == ""


def test_compress_null_and_empty_pieces(spark):
    rows = [("r", 1, None, "a\nb", None), ("r", 2, "T\n2", "", ["snip\npet", "x"]), ("r", 3, "T", None, None), ("r", 4, "T", "", []),
            ("s", 1, "T", "\n" * 50, None), ("s", 2, "T", "z", None), ("empty", 1, "T", None, None)]
    df = spark.createDataFrame(rows, "research_id string, citation_index long, title string, content string, snippets array<string>")
    want = {"r": "[1] \na\nb\n\n[2] T\n2\nsnip\npet\n\n", "s": "[1] T\n" + "\n" * 50 + "\n\n[2] T\nz\n\n"}
    assert {r.research_id: r.context for r in compress_context(df).collect()} == want
    for most in (0, 3, 5, 9, 11, 20):
        got = {r.research_id: r.context for r in compress_context(df, max_chars=most).collect()}
        for run, text in want.items():
            kept, total = [], 0
            for line in text.split("\n") if len(text) > most else []:
                if total + len(line) > most:
                    break
                kept.append(line)
                total += len(line)
            assert got[run] == (text if len(text) <= most else "\n".join(kept)), (run, most)
