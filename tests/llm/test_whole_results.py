"""Cases in which the operators once did less than the whole job."""

import random
import re

import numpy as np
import pyarrow as pa
from llm_fixtures import prose

import corpus_pipeline
from citeline.llm.licenses import FORMS, NAMES, rules, scan_licenses
from citeline.llm.line_dedup import dedup_lines

from citeline.llm.substring_dedup import GAP, _diagonal, _diagonals, _meet, _verify, _windows, passages, repeated_passages


def repeated_lines(rows, least):
    """Lines per document that lie in a run of ``least`` words or more with an
    earlier occurrence; every run of every length is looked at."""
    seen, gone = set(), {}
    for i, text in sorted(rows):
        lines = [" ".join(line.split()) for line in text.split("\n")]
        gone[i] = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for x in lines[a:b + 1] if x)
                if lines[a] and lines[b] and sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[i].update(range(a, b + 1))
                    seen.add(run)
    return gone


def test_line_dedup_deletes_whole_repeated_runs(make, spark):
    rng = random.Random(11)
    line = lambda seed, n: " ".join(prose(seed, n, 10 ** 6))
    pair = f"{line(1, 60)}\n{line(2, 40)}"
    rows = [(1, f"a\n{pair}\nb"), (2, f"c\n{pair}\nd"), (3, pair), (4, f"{line(3, 30)}\n{line(4, 30)}\n{line(5, 10)}")]
    rows.append((5, rows[3][1]))
    pool = [line(100 + k, n) for k, n in enumerate([3, 10, 10, 20, 20, 25, 30, 49, 55])]
    rows += [(10 + k, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randrange(1, 14)))) for k in range(60)]
    want = repeated_lines(rows, 50)
    got = {r.doc_id: r for r in dedup_lines(make(rows)).collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert {k for a, b in got[i].removed for k in range(a, b + 1)} == want[i], i
        assert got[i].n_removed == len(want[i])
        assert got[i].text == "\n".join(x for k, x in enumerate(lines) if k not in want[i])
    assert got[2].text == "c\nd" and got[3].n_removed == 2 and got[5].n_removed == 3
    docs = make([(i, t, "en", "s", len(t)) for i, t in rows[:5]], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert kept == {1: rows[0][1], 2: "c\nd", 4: rows[3][1]}


def standing_rules(text):
    """Detections that stand, from all rules without any gate or keyword."""
    low = text.translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
    spaced = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    found = set()
    for label, _, pattern, priority, confidence in rules():
        for m in re.finditer(pattern, spaced):
            start = len(spaced[:m.start()].split())
            found.add((start, start + len(m[0].split()), priority, label, confidence))
    rank = lambda d: (d[2], d[0], -d[1], d[3])
    return {d for d in found if not any(
        e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and ((e[0], e[1]) != (d[0], d[1]) or rank(e) < rank(d))
        for e in found)}


def test_license_scan_finds_every_form_of_every_name(make):
    plain = lambda pattern: re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", pattern.replace("[0-9]", "2").replace("[sc]", "s"))
    texts = ["Available under CC BY-SA 4.0", "Released under the MIT", "distributed under the terms of the GNU General Public",
             "published under Apache 2.0", "it is available under the bridge", "under mit", "was released. Under CC0 so"]
    for _, _, form in FORMS[:2]:
        texts += [plain(re.sub(r"\{[0-9],?[0-9]?\}", "", form.format(name=name))) for _, name, _ in NAMES]
    verbs = ("released", "distributed", "published", "available")
    texts += [f"{verb} under the terms of the {plain(name)}" for verb in verbs for _, name, _ in NAMES]
    rng = random.Random(12)
    bits = [*verbs, "under", "the", "terms of", "mit", "apache 2", "cc by", "sa", "nc", "gnu general public", "2", "word"]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(200)]
    got = {r.doc_id: r for r in scan_licenses(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = standing_rules(text)
        assert {tuple(d) for d in got[i].detections} == want, text
    assert got[0].labels == "cc-by,cc-by-sa" and got[0].score == 0.95
    assert got[1].labels == "mit" and got[2].labels == "gpl" and got[4].labels == ""
    assert sum(bool(got[i].detections) for i in range(len(texts))) > 250


def test_substring_dedup_finds_passages_inside_longer_runs(make):
    words = lambda seed, n: prose(seed, n, 10 ** 6)

    def changed(run, step, tag):
        return [f"{tag}{k}" if k % step == 0 else w for k, w in enumerate(run)]
    good, tail, more = words(1, 60), words(2, 40), words(3, 60)
    texts = [good + tail, good + changed(tail, 8, "x"),                                     # verbatim, then 65 %
             words(4, 30) + tail + more, words(5, 9) + changed(tail, 8, "y") + more + words(6, 70),
             words(7, 60) + words(8, 40) + words(9, 60), words(7, 60) + changed(words(8, 40), 5, "z") + words(9, 60) + words(10, 30)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = repeated_passages(make(rows)).collect()

    def covered(a, b, start, end):
        return any(r.start_word <= start and r.end_word >= end if r.doc_id == a else r.match_start_word <= start and r.match_end_word >= end
                   for r in got if {r.doc_id, r.match_doc_id} == {a, b})
    assert covered(1, 0, 0, 59) and covered(3, 2, 49, 108)
    assert covered(5, 4, 0, 59) and covered(5, 4, 100, 159)
    for r in got:
        a, b = texts[r.doc_id][r.start_word:r.end_word + 1], texts[r.match_doc_id][r.match_start_word:r.match_end_word + 1]
        x, y = ({tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in (a, b))
        assert len(x & y) >= 0.75 * len(x | y) and min(len(a), len(b)) >= 50


def test_passages_hold_every_span_of_a_diagonal_that_qualifies():
    rng = random.Random(13)
    for _ in range(60):
        n, share = rng.randrange(12, 70), rng.choice([0.03, 0.08, 0.15, 0.3])
        a = np.arange(1, n + 1, dtype=np.uint64)
        b = np.array([10 ** 6 + k if rng.random() < share else k + 1 for k in range(n)], np.uint64)
        got = passages(a, b, {(int(k), int(k)) for k in np.flatnonzero(a == b)}, False, 14, 75)      # at least 10 grams
        for s in range(n):
            for e in range(s + 9, n):
                same = int((a[s:e + 1] == b[s:e + 1]).sum())
                if a[s] == b[s] and a[e] == b[e] and same == e - s + 1:
                    assert any(x <= s and e <= y for x, y, *_ in got)       # every verbatim run
                elif a[s] == b[s] and a[e] == b[e] and 100 * same >= 75 * (2 * (e - s + 1) - same):
                    assert any(x <= e and s <= y for x, y, *_ in got)       # every near one is met


def test_diagonals_of_many_anchors_are_those_taken_one_by_one():
    rng = random.Random(14)
    for same in (False, True) * 20:
        a = np.array([rng.randrange(12) for _ in range(rng.randrange(5, 60))], np.uint64)
        b = a if same else np.array([rng.randrange(12) for _ in range(rng.randrange(5, 60))], np.uint64)
        hits = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
        anchors = rng.sample(hits, min(len(hits), 40))
        want = {}
        for i, j in sorted(anchors):
            if i - j not in want and not (same and i == j) and not any(i in at for d, at in want.items() if abs(d - i + j) <= GAP):
                want[i - j] = _diagonal(a, b, i - j)
        got = _diagonals(a, b, np.array(anchors, np.int64).reshape(-1, 2), same)
        assert list(got) == list(want) and all((got[d] == want[d]).all() for d in want)


def test_passages_join_an_insertion_without_the_edited_tail():
    a = np.arange(1, 91, dtype=np.uint64)                       # 26 grams, 5 over the inserted word, 26 grams, an edited tail
    b = np.concatenate([a[:26], np.arange(901, 906, dtype=np.uint64), a[30:56], np.where(a[56:] % 7 == 0, a[56:], a[56:] + 5000)]).astype(np.uint64)
    got = passages(a, b, {(10, 10), (40, 41)}, False, 50, 75)
    assert any(s == 0 and e >= 55 and t == 0 and f >= 56 for s, e, t, f, _ in got)


def test_substring_dedup_pairs_documents_that_fail_against_the_hub(make):
    rows = []
    for k in range(200):
        common, rest = prose(20000 + k, 45, 10 ** 7), prose(30000 + k, 10, 10 ** 7)
        rows.append((10 * k, " ".join(common + prose(40000 + k, 6, 10 ** 7))))                   # the hub holds 45 words of 55
        rows += [(10 * k + n, " ".join(prose(50000 + 10 * k + n, 60, 10 ** 7) + common + rest + prose(60000 + 10 * k + n, 60, 10 ** 7)))
                 for n in (1, 2, 3)]
    got = repeated_passages(make(rows)).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        spans.setdefault(r.match_doc_id, []).append((r.match_start_word, r.match_end_word))
    for k in range(200):
        for n in (1, 2, 3):
            assert any(s <= 60 and e >= 114 for s, e in spans.get(10 * k + n, [])), (k, n)
    assert len({(r.doc_id, r.start_word, r.match_doc_id, r.match_start_word) for r in got}) == len(got)


def test_substring_dedup_pairs_edited_passages_that_fail_against_the_hub(make):
    rows, words = [], lambda seed, n: prose(seed, n, 10 ** 7)
    for k in range(12):
        run, rng = words(1000 + k, 62), random.Random(k)
        edited, at = list(run), rng.randrange(5, 57)
        edited[at] = "changed"
        rows += [(100 * k + n, " ".join(words(2000 + 2 * k + n, 80) + t + words(3000 + 2 * k + n, 80))) for n, t in enumerate((run, edited))]
        for n in range(10):                                                                     # shorter, with 40 words of 62
            cut = rng.randrange(23)
            rows.append((100 * k + 10 + n, " ".join(words(60000 + 20 * k + n, 6) + run[cut:cut + 40] + words(80000 + 20 * k + n, 6))))
    got = repeated_passages(make(rows)).collect()
    pairs = {frozenset((r.doc_id, r.match_doc_id)) for r in got}
    assert all(frozenset((100 * k, 100 * k + 1)) in pairs for k in range(12))
    for r in got:
        a, b = (dict(rows)[i].split()[s:e + 1] for i, s, e in ((r.doc_id, r.start_word, r.end_word), (r.match_doc_id, r.match_start_word, r.match_end_word)))
        x, y = ({tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in (a, b))
        assert len(x & y) >= 0.75 * len(x | y) and min(len(a), len(b)) >= 50


def test_substring_dedup_pairs_passages_that_fail_against_two_shorter_documents(make):
    rows, words = [], lambda seed, n: prose(seed, n, 10 ** 7)
    for k in range(16):
        run, rng = words(1000 + k, 62), random.Random(k)
        edited = list(run)
        edited[rng.randrange(4, 58)] = f"changed{rng.randrange(10 ** 9)}"
        rows += [(1000 * k + n, " ".join(words(2000 + 5 * k + n, 80) + t + words(900000 + 5 * k + n, 80))) for n, t in enumerate((run, edited))]
        for held, pad in ((40, 3), (49, 5)):                                                    # every run of 40 and of 49 words of the 62
            for cut in range(63 - held):
                n = 1000 * k + 100 * pad + cut
                rows.append((n, " ".join(words(60000 + n, pad) + run[cut:cut + held] + words(8000000 + n, pad))))
    pairs = {frozenset((r.doc_id, r.match_doc_id)) for r in repeated_passages(make(rows)).collect()}
    assert pairs == {frozenset((1000 * k, 1000 * k + 1)) for k in range(16)}                    # before: 15 of them


def test_windows_of_a_text_with_one_key_are_one_row():
    line = prose(1, 60, 10 ** 6)
    texts = pa.RecordBatch.from_arrays([pa.array([3, 4]), pa.array([" ".join(line * 40), " ".join(line + prose(2, 80, 10 ** 6))])], ["doc_id", "text"])
    windows = pa.Table.from_batches(list(_windows(50)(iter([texts])))).sort_by([(c, "ascending") for c in ("key", "rank", "doc_id", "place")])
    rows = windows.to_pylist()
    assert len({(r["key"], r["doc_id"], r["hub"]) for r in rows}) == len(rows)          # before: one row for each of 40 places
    met = [r for b in _meet(iter(windows.to_batches(7))) for r in b.to_pylist()]
    loop = [r for r in met if r["doc_id"] == 3]
    anchors = {int(x) for r in loop for x in np.frombuffer(r["anchors"], np.int64)}
    n_windows = sum(1 + len(r["more"]) // 16 for r in rows)
    assert n_windows > 10 * len(rows) and len(met) <= len(rows)
    assert sum(len(r["anchors"]) // 8 for r in met) == n_windows - len({r["key"] for r in rows})    # all but each key's first
    assert all(((x >> 32) - ((x & (1 << 32) - 1) >> 1)) % 60 == 0 for x in anchors) and len(anchors) > 100
    assert all(len(r["extents"]) == (len(r["anchors"]) // 8 if r["number"] == 0 else 0) for r in met)


def test_equal_texts_with_one_hub_are_verified_once(make):
    run, other = prose(1, 70, 10 ** 6), prose(2, 90, 10 ** 6)
    text, hub = " ".join(run + other), " ".join(prose(3, 5, 10 ** 6) + run)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([9]), pa.array([[np.array([20 << 32 | 25 << 1], np.int64).tobytes()]], pa.list_(pa.binary())),
         pa.array([[1, 5, 7]]), pa.array([text]), pa.array([hub])], ["doc_id", "hub", "anchors", "copies", "text", "hub_text"])
    rows = pa.Table.from_batches(list(_verify(50, 75)(iter([batch])))).to_pylist()
    found = [r for r in rows if r["key"] is None]
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["match_doc_id"], r["match_start_word"]) for r in found] == [(d, 0, 69, 9, 5) for d in (1, 5, 7)]
    stops = {d: {(r["key"], r["place"], r["stop"], r["match"]) for r in rows if r["key"] is not None and r["doc_id"] == d} for d in (1, 5, 7)}
    assert stops[1] and stops[1] == stops[5] == stops[7]
    assert len({r["rank"] for r in rows if r["key"] is not None}) == 3
    got = repeated_passages(make([(9, hub), *((10 + k, text) for k in range(150))])).collect()          # more copies than one row holds
    assert {10 + k for k in range(150)} <= {i for r in got if r.end_word - r.start_word >= 69 for i in (r.doc_id, r.match_doc_id)}
    assert sum(r.match_doc_id == 9 for r in got) > 50
