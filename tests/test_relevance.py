"""Keyword containment join, as-of visibility, context selection (sections,
sources fixtures), checked against a brute-force evaluation."""

import random

from citeline.operators import relevance as rv

WORDS = ["data", "Study", "ocean", "oceanic", "heat", "water", "the", "report", "climate", "ice", "icecap"]


def fixture(spark, seed=7, n_src=60, n_sec=8):
    rnd = random.Random(seed)
    srcs, counter = [], {}
    for i in range(n_src):
        body = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12)))
        content = "" if i % 9 == 4 else body * rnd.randint(1, 40)
        run = "r" if i % 5 else "s"
        counter[run] = counter.get(run, 0) + 1          # dense per-run citation numbers
        srcs.append((run, i, i, counter[run], f"T{i} " + rnd.choice(WORDS), rnd.choice(["", "icecaps"]), content))
    secs = [("r" if j % 3 else "s", j, rnd.randint(-1, n_src), " ".join(rnd.choice(WORDS + ["Ocean", "Heat"])
                                                                        for _ in range(rnd.randint(0, 5))))
            for j in range(n_sec)]
    secs.append(("r", 99, 0, "zzzz qqqq"))
    src_df = spark.createDataFrame(srcs, "research_id string, seq long, step long, citation_index long, "
                                         "title string, description string, content string")
    sec_df = spark.createDataFrame(secs, "research_id string, sec_id long, step long, title string")
    return srcs, secs, src_df, sec_df


def brute_scores(srcs, secs):
    out = {}
    for run, sid, sstep, title in secs:
        kws = [k for k in title.lower().split() if len(k) > 3]
        for r, seq, step, _, t, d, c in srcs:
            if r != run or step > sstep:
                continue
            body = (c + t + d).lower()
            score = sum(1 for k in kws if k in body)
            if score:
                out[(sid, seq)] = score
    return out


def test_relevance_matches_brute_force(spark):
    srcs, secs, src_df, sec_df = fixture(spark)
    got = {(r.sec_id, r.seq): r.score
           for r in rv.section_relevance(sec_df, src_df).collect()}
    assert got == brute_scores(srcs, secs)
    assert got  # the fixture produces matches


def test_context_matches_brute_force(spark):
    srcs, secs, src_df, sec_df = fixture(spark)
    got = {r.sec_id: r.context for r in rv.section_context(sec_df, src_df).collect()}
    renumbered = rv.section_context(sec_df, src_df.drop("citation_index"))
    assert got == {r.sec_id: r.context for r in renumbered.collect()}
    scores = brute_scores(srcs, secs)
    by_seq = {s[1]: s for s in srcs}
    want = {}
    for run, sid, sstep, _ in secs:
        ranked = sorted([(-v, seq) for (k, seq), v in scores.items() if k == sid])[:10]
        blocks, total = [], 0
        for _, seq in ranked:
            s = by_seq[seq]
            snip = s[6][:1000]
            if not snip:
                continue
            blocks.append(f"[{s[3]}] {s[4]}\n{snip}\n")
            total += len(snip)
            if total > 3000:
                break
        if not blocks:
            visible = sorted((s for s in srcs if s[0] == run), key=lambda s: (s[2], s[1]))[:5]
            blocks = [f"[{s[3]}] {s[4]}\n{s[6][:500]}\n" for s in visible if s[2] <= sstep and s[6][:500]]
        want[sid] = "\n".join(blocks) if blocks else rv.NO_INFO
    assert got == want
    assert got[99] == rv.NO_INFO      # no keyword matches and no source visible yet


def test_keyword_multiplicity_and_substring(spark):
    src = spark.createDataFrame([("r", 1, 0, 1, "", "", "the OCEANIC heat")],
                                "research_id string, seq long, step long, citation_index long, title string, "
                                "description string, content string")
    sec = spark.createDataFrame([("r", 1, 0, "Ocean ocean heat the"), ("r", 2, 0, "oceanic heats")],
                                "research_id string, sec_id long, step long, title string")
    got = {r.sec_id: r.score for r in rv.section_relevance(sec, src).collect()}
    # 'ocean' twice (substring of 'oceanic'), 'heat' once, 'the' too short; 'heats' is not in the text
    assert got == {1: 3, 2: 1}


def test_assemble_sections_prefix(spark):
    d = spark.createDataFrame([("r", i, f"S{i}", "b" * 100) for i in range(500)],
                              "research_id string, sec_id long, title string, body string")
    out = rv.assemble_sections(d, "research_id", "sec_id", "title", "body", 8000).first().sections_text
    full = "\n\n".join(f"## S{i}\n\n" + "b" * 100 for i in range(500))
    assert out == full[:8000]


def test_keywords_inside_long_tokens(spark):
    long_token = "x" * 25 + "OCEAN" + "y" * 40 + "heat"          # 74 characters, one token
    src = spark.createDataFrame([("r", 1, 0, 1, "", "", long_token), ("r", 2, 0, 2, "", "", "oce an")],
                                "research_id string, seq long, step long, citation_index long, title string, "
                                "description string, content string")
    sec = spark.createDataFrame([("r", 1, 0, "ocean heat yyyyyyyy xxxo")],
                                "research_id string, sec_id long, step long, title string")
    got = {r.seq: r.score for r in rv.section_relevance(sec, src).collect()}
    assert got == {1: 4}


def test_context_takes_the_first_snippet_of_an_empty_source(spark):
    src = spark.createDataFrame([("r", 1, 0, "ocean", "", "", ["first " + "x" * 1200, "second"]), ("r", 2, 0, "ocean", "", None, []),
                                 ("r", 3, 1, "ocean", "", "text", ["unused"])],
                                "research_id string, seq long, step long, title string, description string, content string, "
                                "snippets array<string>")
    sec = spark.createDataFrame([("r", 1, 1, "the ocean")], "research_id string, sec_id long, step long, title string")
    got = rv.section_context(sec, src).first().context
    assert got == "[1] ocean\nfirst " + "x" * 1200 + "\n\n[3] ocean\ntext\n"


def test_context_of_empty_tables(spark):
    schema = "research_id string, seq long, step long, title string, description string, content string"
    sec = spark.createDataFrame([("r", 1, 1, None)], "research_id string, sec_id long, step long, title string")
    assert [r.context for r in rv.section_context(sec, spark.createDataFrame([], schema)).collect()] == [rv.NO_INFO]
    assert rv.section_context(sec.where("false"), spark.createDataFrame([("r", 1, 0, "t", "d", "c")], schema)).collect() == []
