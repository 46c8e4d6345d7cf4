"""N-gram join, substring dedup and line dedup against brute force."""

import random
import re
from collections import Counter, defaultdict

from llm_fixtures import prose

from citeline.llm.line_dedup import dedup_lines
from citeline.llm.ngram_join import ngram_components
from citeline.llm.substring_dedup import repeated_passages

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(rows):
    sets = defaultdict(set)
    for i, t in rows:
        sets[i] = grams(t)
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    common = Counter((a, b) for ids in where.values() for a in ids for b in ids if a < b)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 9)}"
    return words


def corpus():
    """Copies, a star of edited copies, a chain of drifting copies, passages
    shared by many, short and odd texts."""
    rng = random.Random(1)
    base, passage = prose(1, 120), prose(2, 60)
    texts = [" ".join(prose(100 + i, rng.choice([3, 5, 8, 40, 150]))) for i in range(60)]
    texts += [" ".join(base)] * 40 + [" ".join(edited(base, rng.randrange(9), rng)) for _ in range(120)]
    drift = prose(3, 200)
    for _ in range(25):
        drift = edited(drift, 3, rng)
        texts.append("\t".join(drift))
    texts += [" ".join(prose(300 + i, 30) + passage + prose(400 + i, 30)) for i in range(40)]
    texts += [" ".join(passage + prose(500 + i, rng.randrange(12))) for i in range(40)]
    texts += [None, "", "  \n", "one", "ONE", "one two", "a b c d", "A b\nc  d", "a b c d e", "é É", "ß " * 300, "same " * 5000]
    return list(enumerate(texts))


def test_ngram_components_match_brute_force(make):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(make(rows)).collect()}
    assert got == classes(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 150


def test_ngram_hot_lists_are_combined_before_the_shuffle(make, monkeypatch):
    import citeline.llm.ngram_join as module
    monkeypatch.setattr(module, "LOCAL_HOT", 2)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(make(rows)).collect()}
    assert got == classes(rows)


def test_ngram_sides_beyond_the_limit_are_shuffled(make, monkeypatch):
    import citeline.llm.ngram_join as module
    rows, limits, plain = corpus()[::4], [], module.small

    def spy(df, *limit):
        limits.append(limit)
        return plain(df, *limit)
    monkeypatch.setattr(module, "small", spy)
    monkeypatch.setattr(module, "KEY_ROWS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(make(rows)).collect()}
    assert got == classes(rows)
    # one side at most has the wide limit in a job: the ids whose texts are read, once for each counted table of pairs
    assert len(limits) > 12 and sum(not x for x in limits) <= 3 and all(x in ((), (0,)) for x in limits)


def test_ngram_edges(make, spark):
    assert ngram_components(make([])).collect() == []
    df = make([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (8, None)]).selectExpr(
        "doc_id", "text", "1 as component_id", "'x' as token")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 0, 8)], key=str)


def shared_runs(rows, least):
    """Documents that hold a run of ``least`` words that also occurs elsewhere."""
    seen = defaultdict(set)
    for i, t in rows:
        words = (t or "").translate(LOWER).split()
        for k in range(len(words) - least + 1):
            seen[tuple(words[k:k + least])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_repeated_passages(make):
    rng = random.Random(5)
    passage, other = prose(7, 55, 10 ** 6), prose(8, 300, 10 ** 6)
    texts = [" ".join(prose(900 + i, 200, 10 ** 6)) for i in range(30)]
    texts += [" ".join(prose(1000 + i, rng.randrange(80), 10 ** 6) + passage + prose(1100 + i, rng.randrange(80), 10 ** 6)) for i in range(40)]
    texts += [" ".join(prose(1200, 20, 10 ** 6) + other[:150] + ["inserted"] + other[150:]), " ".join(other)]
    texts += [" ".join(prose(1300 + i, 40, 10 ** 6) + passage[:40]) for i in range(5)]      # too short a share
    texts += [None, "", "few words", " ".join(passage + prose(1400, 100, 10 ** 6) + passage), "again " * 400]
    rows = list(enumerate(texts))
    got = repeated_passages(make(rows)).collect()
    touched = {r.doc_id for r in got} | {r.match_doc_id for r in got}
    must = shared_runs(rows, 50)
    assert must <= touched
    assert touched - must <= set(range(72, 77)) | {len(rows) - 1}      # the near-threshold ones and the loop at most
    for r in got:
        words = {i: (rows[i][1] or "").split() for i in (r.doc_id, r.match_doc_id)}
        a = grams(" ".join(words[r.doc_id][r.start_word:r.end_word + 1]))
        b = grams(" ".join(words[r.match_doc_id][r.match_start_word:r.match_end_word + 1]))
        assert len(a & b) >= 0.75 * len(a | b) and r.end_word - r.start_word + 1 >= 50
    for i in range(30, 70):
        spans = [r for r in got if r.doc_id == i]
        at = texts[i].split().index(passage[0])
        assert len([r for r in got if r.match_doc_id == i]) or any(r.start_word <= at and r.end_word >= at + 54 for r in spans)
    assert any(r.doc_id == 70 and r.end_word - r.start_word >= 299 for r in got)
    assert len(got) < 2 * len(rows)
    assert repeated_passages(make([])).collect() == []
    assert repeated_passages(make([(None, " ".join(passage)), (1, " ".join(passage))])).collect() == []


def test_line_dedup_edges(make):
    long_line = " ".join(prose(1, 60))
    three = "\n".join(" ".join(prose(10 + k, 20)) for k in range(3))
    rows = [(1, f"intro\n{long_line}\nend"), (2, f"{long_line}\nother"), (2, f"{long_line}\nother"), (3, None), (4, ""),
            (None, f"{three}\ntail"), (5, f"head\n\n{three.replace(' ', '  ')}\nfoot"), (6, "short\nshort\nshort"),
            (7, f"{long_line}\nx\n{long_line}"), (8, "\n".join([long_line, long_line])), (9, "\n".join(f"line {k} " + long_line for k in range(3000)))]
    df = make(rows).selectExpr("doc_id", "text", "7 as n_lines", "'k' as content", "doc_id as did")
    got = defaultdict(list)
    for r in dedup_lines(df).collect():
        got[r.doc_id].append((r.n_lines, r.n_removed, r.text, [tuple(x) for x in r.removed]))
    assert got[1] == [(3, 0, rows[0][1], [])]
    assert got[2] == [(2, 1, "other", [(0, 0)])] * 2
    assert got[3] == [(0, 0, None, [])] and got[4] == [(1, 0, "", [])]
    assert got[None] == [(4, 0, rows[5][1], [])]
    assert got[5] == [(6, 3, "head\n\nfoot", [(2, 4)])]
    assert got[6][0][1] == 0 and got[7] == [(3, 2, "x", [(0, 0), (2, 2)])]
    assert got[8] == [(2, 2, "", [(0, 1)])] and got[9][0][:2] == (3000, 0)
    assert dedup_lines(make([])).collect() == []
