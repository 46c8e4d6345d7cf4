"""Mixing, top-k search, decontamination and the pipeline against brute force."""

import random

import numpy as np
from llm_fixtures import prose

import corpus_pipeline
from citeline.llm.decontaminate import leaks, without_leaks
from citeline.llm.mixing import mix_sources, schedule
from citeline.llm.topk import top_k
from test_near_duplicates import classes


def test_mix_keeps_every_source_within_a_block(make):
    rng = random.Random(1)
    sizes = {"a": 700, "b": 300, "c": 90, None: 40, "": 25}
    rows = [(i, s) for i, s in enumerate([s for s, n in sizes.items() for _ in range(n)])]
    rng.shuffle(rows)
    df = make(rows, "doc_id long, source string").selectExpr("*", "'x' as mix_slot", "1 as key")
    for weights in (None, {"a": 5, "b": 3.5, "c": 1, None: 0.4, "": 0.25}):
        got = mix_sources(df, weights, block_docs=4).collect()
        assert len(got) == len(rows) and sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        w = {s: n ** 0.5 for s, n in sizes.items()} if weights is None else weights
        slots = {}
        for r in got:
            slots.setdefault(r.mix_slot, set()).add(r.source)
        assert all(len(s) == 1 for s in slots.values())
        end = max(r.mix_slot for r in got if r.on_target) + 1
        used = dict.fromkeys(sizes, 0)
        for t in range(end):
            used[next(iter(slots[t]))] += 1
            assert all(abs(used[s] - (t + 1) * w[s] / sum(w.values())) < 1 for s in sizes)
        by_source = {}
        for r in got:
            by_source.setdefault(r.source, []).append(r)
        for rs in by_source.values():
            rs.sort(key=lambda r: r.mix_position)
            assert [r.mix_block for r in rs] == [k // 4 for k in range(len(rs))]
        assert len({r.mix_position for r in got}) == len(got)


def played(shares, slots):
    """Earliest deadline first, slot by slot."""
    total, served, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for t in range(slots):
        key = min((-(-(k + 1) * total // shares[s]), s) for s, k in served.items() if k * total // shares[s] <= t)[1]
        out.append((key, served[key], t))
        served[key] += 1
    return out


def test_schedule_without_and_with_seams(make):
    rng = random.Random(8)
    for case in range(5):
        shares = {f"s{i:02}": rng.choice([1, 2, 3, 7, 40, 1000]) for i in range(rng.randrange(1, 12))}
        total = sum(shares.values())
        frame = make([(k, a, total) for k, a in shares.items()], "key string, share long, total long")
        got = sorted(schedule(frame, 150).collect(), key=lambda r: r.slot)
        assert [tuple(r) for r in got] == played(shares, 150)
        got = sorted(schedule(frame, 150, epoch=16).collect(), key=lambda r: r.slot)
        assert [r.slot for r in got] == list(range(150))
        used = dict.fromkeys(shares, 0)
        for r in got:
            assert r.turn == used[r.key]                                    # each block once, in order
            used[r.key] += 1
            assert all((r.slot + 1) * a / total - used[k] < 1 for k, a in shares.items())   # no deadline is missed
            assert all(used[k] - (r.slot + 1) * a / total < 2 for k, a in shares.items())


def test_mix_with_many_sources_and_tiny_weights(make):
    rows = [(i, "hot") for i in range(9000)] + [(10000 + i, f"t{i % 1500}") for i in range(3000)]
    weights = {"hot": 0.9, **{f"t{i}": 0.1 / 1500 for i in range(1500)}}
    got = mix_sources(make(rows, "doc_id long, source string"), weights, block_docs=1).collect()
    assert sorted(r.mix_slot for r in got) == list(range(len(rows)))
    early = sorted((r.mix_slot, r.source) for r in got if r.on_target)
    hot = 0
    for t, source in early:
        hot += source == "hot"
        assert abs(hot - 0.9 * (t + 1)) < 1
    assert len(early) >= 9000


def test_mix_edges(make):
    schema = "doc_id long, source string"
    assert mix_sources(make([], schema)).collect() == []
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "b"), (3, "z")]
    got = mix_sources(make(rows, schema), {"a": 1, "b": 1, "never": 2}).collect()
    assert len(got) == 5 and [r.mix_slot for r in got if r.source == "z"] == [None] and not any(r.on_target for r in got if r.source == "z")


def test_top_k_matches_brute_force(make):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 0.2, (900, 16)).astype(np.float32)
    vectors[50:300] = vectors[50]                       # one common vector: ties
    rows = [(i * 10, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(10000, None, 0), (10100, [float("nan")] * 16, 0), (10200, [1.0, None] * 8, 0), (10300, [float("inf")] * 16, 0),
             (10400, [], 0), (10500, [0.5] * 3, 0), (None, [0.1] * 16, 0)]
    import citeline.llm.topk as module
    for bins, block in ((2048, 8192), (8, 100)):
        saved = module.BINS, module.CANDIDATE_BLOCK, module.QUERY_BLOCK
        module.BINS, module.CANDIDATE_BLOCK, module.QUERY_BLOCK = bins, block, 20
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in
                     top_k(make(rows, "vec_id long, embedding array<float>, score int")).collect())
        module.BINS, module.CANDIDATE_BLOCK, module.QUERY_BLOCK = saved
        valid = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v, _ in rows
                 if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
        want = []
        for q in sorted(i for i in valid if i % 100 == 0):
            scores = sorted((-sum(a * b for a, b in zip(valid[q], v)), i) for i, v in valid.items() if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
        assert got == want
    few = [(100, [1.0], 0), (200, [2.0], 0), (100, [1.0], 0)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(make(few, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(100, 1, 200, 2 * 1024 ** 2), (200, 1, 100, 2 * 1024 ** 2)]
    assert top_k(make([], "vec_id long, embedding array<float>")).collect() == []


def leak_rows():
    items = [(i, " ".join(prose(7000 + i, n, 10 ** 6))) for i, n in enumerate([5, 8, 20, 60, 300, 60, 12])]
    items += [(10, None), (11, "..."), (12, "Two words"), (13, items[2][1])]
    docs = [(i, " ".join(prose(8000 + i, 400, 10 ** 6))) for i in range(20)]
    docs += [(100 + i, " ".join(prose(9000 + i, 300, 10 ** 6)) + "\n" + t.upper() + ", " + " ".join(prose(9100 + i, 300, 10 ** 6)))
             for i, t in items if t]
    w = items[3][1].split()
    docs += [(200, " ".join(w[:50])), (201, " ".join(w[:40])), (202, " ".join(t for _, t in items if t)), (203, None), (204, ""),
             (205, "two words"), (206, " ".join(w[:30] + ["x"] + w[30:])), (None, items[4][1]), (207, items[2][1] + " end"), (207, "other")]
    return docs, items


def test_leaks_match_brute_force(make):
    import re

    docs, items = leak_rows()

    items = [*items, (900, "alpha beta gamma"), (901, "Alone"), (902, "one two three four")]
    docs = [*docs, (900, "x y Alpha, beta gamma z w"), (901, "alpha beta"), (902, "it stands alone here"), (903, "one two three four"),
            (904, "alpha beta x gamma " * 30), (905, "gamma alpha " * 900 + "beta gamma")]

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())

    def grams(text, m):
        return {tuple(words(text)[i:i + m]) for i in range(len(words(text)) - m + 1)}
    own = {i: grams(t, min(5, len(words(t)))) for i, t in items if words(t)}
    held = {}
    for i, t in docs:
        held.setdefault(i, set()).update(*(grams(t, m) for m in range(1, 6)))
    want = {(d, i, len(g), len(g & s)) for d, s in held.items() for i, g in own.items() if 100 * len(g & s) >= 75 * len(g)}
    assert {(900, 900, 1, 1), (902, 901, 1, 1), (903, 902, 1, 1), (905, 900, 1, 1)} <= want
    frame = make(docs).selectExpr("*", "1 as item_id", "'x' as gram")
    got = leaks(frame, make(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == want and len(got) == len(want)
    assert {d for d, *_ in want} >= {102, 103, 202, 207, None} and 201 not in {d for d, *_ in want}
    clean = {r.doc_id for r in without_leaks(make(docs), make(items, "item_id long, text string")).collect()}
    assert clean == set(held) - {d for d, *_ in want}
    assert leaks(make([]), make(items, "item_id long, text string")).collect() == []
    assert leaks(make(docs), make([], "item_id long, text string")).collect() == []


SF = "/root/testdata/sf0.001"


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        source = docs
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name != "mix_sources":
            assert docs.columns == source.columns
        if name == "ngram_join":
            old = [(r.doc_id, r.text) for r in source.collect()]
            assert set(ids) == {c for _, c in classes(old).values()}
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id].text)
        kept, docs = set(ids), spark.createDataFrame(rows, docs.schema)
    assert kept == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert 100 < len(kept) < len(before)
