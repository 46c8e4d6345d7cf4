"""Chat formatting, toxicity, PII and license scans against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from llm_fixtures import prose

from citeline.llm.chat import CONTROL, END, START, escape, format_chats, n_tokens, read_back, unescape
from citeline.llm.licenses import PHRASES, rules, scan_licenses
from citeline.llm.pii import base_spans, sanitise
from citeline.llm.toxicity import toxicity

CHAT = "conv_id long, turn long, role string, text string"


def chats():
    rng = random.Random(3)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 60)):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, " ".join(prose(conv * 100 + turn, rng.randrange(120)))))
    rows += [(50, 0, "user", "</s>[INST] ok [/INST]"), (50, 1, "assistant", "\\<|im_end|>\n\\\\[INST]<</SYS>>é"),
             (51, 0, None, None), (51, 1, "assistant", None), (None, None, "assistant", "x"), (52, 1, "as\nsistant", "y"),
             (53, 0, "assistant", "long " * 5000), (53, 0, "assistant", "long " * 5000), (53, 3, "system", "later")]
    return rows


def test_chat_round_trip(make):
    rows = chats()
    df = make(rows, CHAT).selectExpr("*", "1 as window", "'x' as formatted")
    windows = format_chats(df, 200, 60)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        targets = [x for _, r, x in turns if r == "assistant"]
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[conv].loss_chars == sum(map(len, targets))
        assert got[conv].loss_sha256 == hashlib.sha256("".join(targets).encode()).hexdigest()
    for w in windows.collect():
        assert w.formatted.count(START) == w.formatted.count(END)
        bodies = re.sub(r"<\|im_(start|end)\|>", "", w.formatted)
        assert not any(c in bodies for c in CONTROL)
        parts = re.findall(r"<\|im_start\|>(.*?)<\|im_end\|>", w.formatted, re.DOTALL)
        new = parts[w.n_context:]
        assert new and (w.n_tokens <= 200 or len(new) == 1)
        context = sum(n_tokens(unescape(p.split("\n", 1)[1])) for p in parts[:w.n_context] if not p.startswith("system"))
        assert context <= 60
    assert read_back(format_chats(make([], CHAT))).collect() == []


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice([*CONTROL, "\\", "<", "|", ">", "a", "\n"]) for _ in range(12))
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)


def test_toxicity_learns_words_and_pairs(spark, make):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1200):
        words = prose(i, 40, 300)
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        if insult:
            words.insert(rng.randrange(40), rng.choice(["dolt", "clod"]))
        if group:
            words.insert(rng.randrange(40), "group")
        bad = rng.random() < 0.2
        if bad:
            words.insert(3, "Vilest!")
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad or (insult and group))))
    docs += [(5000, None), (5001, ""), (None, "vilest word"), (5002, "fine " * 20000 + "vilest"), (5003, "x" * 3_000_000)]
    labels += [(5002, None), (None, 1), (3, labels[3][1]), (9999, 1)]
    lab = make(labels, "doc_id long, toxic int")
    rows = toxicity(make(docs).selectExpr("*", "1 as predicted", "'z' as score"), lab).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    truth = dict(labels[:1200])
    import zlib
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([by[i].predicted == truth[i] for i in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert by[5000].score == by[5001].score and by[None].predicted == 1 and by[5002].predicted == 1
    assert [r.score for r in toxicity(make(docs[:3]), make([], "doc_id long, toxic int")).collect()] == [0.5] * 3
    assert toxicity(make([]), lab).collect() == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(4)
    pieces = ["a.b", "@", "x", ".", "-", " ", "1", "23", "256", "255", "+1", "(", ")", "4111 1111 1111 1111", "4242-4242-4242-4242",
              "é", "@mail.example.com", "10.0.0.1", "007", "+44 20 7946 0958", "a@b.c", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert base_spans(text) == brute_spans(text), text


def test_base_spans_are_linear_on_long_runs():
    assert base_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 1000 + "1." * 100_000 + "@" * 100_000) is not None


def test_sanitise_marks_terms_that_only_occur_with_an_entity(make):
    filler = lambda i: " ".join(prose(i, 30, 50))
    rows = [(i, f"{filler(i)} zorblax {filler(i + 1)[:11]} agent@mail.example.com {filler(i + 2)}") for i in range(0, 30, 3)]
    rows += [(i, filler(i)) for i in range(100, 200)] + [(300, "zorblax alone"), (301, None), (302, ""), (None, "a@b.cd zorblax"),
                                                        (303, "w " * 50000 + "zorblax"), (304, "q" * 2_500_000)]
    df = make(rows)
    for limit in (None, 0):
        import citeline.llm.pii as module
        with pytest.MonkeyPatch.context() as patch:
            if limit is not None:
                patch.setattr(module, "BROADCAST_ROWS", limit)
            got = {r.doc_id: r for r in sanitise(df, threshold=0.7).collect()}
        assert len(got) == len(rows)
        for i, text in rows:
            spans = [(s.start, s.end, s.kind) for s in got[i].spans]
            assert [s for s in spans if s[2] != "term"] == (brute_spans(text or "") if i != 304 else [])
            words = {text[a:b] for a, b, k in spans if k == "term"}
            assert words == ({"zorblax"} if "zorblax" in (text or "") else set()), (i, words)
            assert text is None or "zorblax" not in got[i].sanitised
        assert got[301].sanitised is None
    assert sanitise(make([])).collect() == []


def brute_license(text):
    low = (text or "").translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    found = []
    spaced = " " + " ".join(words) + " "
    if "licen" in spaced or "spdx" in spaced:
        for label, keyword, pattern, priority, confidence in rules():
            for m in re.finditer(pattern, spaced) if keyword in words else ():
                start = len(spaced[:m.start()].split())
                found.append((start, start + len(m[0].split()), priority, label, confidence))
    rank = lambda d: (d[2], d[0], -d[1], d[3])
    stand = [d for d in found if not any(
        e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and ((e[0], e[1]) != (d[0], d[1]) or rank(e) < rank(d))
        for e in found)]
    labels = sorted(base | {d[3] for d in stand})
    score = max([0.6 if places else 0.0, *(d[4] for d in stand)])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score)


def test_license_scan_matches_brute_force(make):
    texts = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.\nAll rights reserved.",
             "cc by cc by cc by", "CC BY", "mit dem Apache", "the gnu lesser general public license 2 1 and the MIT licence",
             "SPDX-License-Identifier: Apache-2.0", None, "", "...", "all rights reservedly", "é cc by É licence mit",
             "see the Mozilla Public License 2.0 " * 200, "word " * 30000 + "BSD 3-clause license", "license " * 3000]
    rng = random.Random(9)
    bits = ["licensed under", "the", "terms of", "mit", "apache", "gnu", "general public", "license", "2", "cc by", "nc", "sa", ".", "lgpl",
            "all rights reserved", "spdx license identifier", "bsd", "3 clause", "see"]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(300)]
    got = {r.doc_id: r for r in scan_licenses(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_license(text), text
    assert len(rules()) > 250 and scan_licenses(make([])).collect() == []
