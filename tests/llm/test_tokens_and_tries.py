"""Tokenizer alignment, packing and the conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import citeline.llm.prefix_trie as trie_module
import citeline.llm.subwords as subwords
from citeline.llm.alignment import align, lockstep, most_pairs, token_links
from citeline.llm.packing import cut, deal, differencing, pack, powers, take
from citeline.llm.prefix_trie import Parentheses, prefix_trie
from citeline.llm.subwords import ByteBpe, PieceBpe, file_of

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def texts(seed=3):
    rng = random.Random(seed)
    alphabet = " \n\tab Zé日.,'1  <s>\x1c​\x85’ll"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(60)]
    prose = [" ".join(rng.choice(["the", "model", "don't", "x=1;", "Straße", "niño,", "foo.\nBar", "12345"]) for _ in range(rng.randrange(300)))
             for _ in range(40)]
    return [None, "", " ", "a", "<|endoftext|>", "a <|endoftext|> b</s> <s>", "▁ mark", "a▁b c", "日本語 テスト。", "\x00 nul", *made, *prose,
            "the same text", "the same text", "word " * 40_000, "x" * 70_000]


@pytest.fixture(scope="module")
def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    plain, special = (Tokenizer.from_file(file_of(A_FILE)) for _ in "ab")
    plain.encode_special_tokens = True
    return plain, special, SentencePieceProcessor(model_file=file_of(B_FILE))


def test_ids_equal_the_libraries(sides, monkeypatch):
    plain, special, piece = sides
    monkeypatch.setattr(subwords, "LONG", 50)           # many cuts
    a, s, b = ByteBpe(A_FILE, True), ByteBpe(A_FILE, False), PieceBpe(B_FILE)
    assert a.fast is not None
    for text in texts()[1:-1]:
        assert a.ids(" " + text).tolist() == plain.encode(" " + text, add_special_tokens=False).ids
        assert s.ids(text).tolist() == special.encode(text, add_special_tokens=False).ids
        assert b.ids(text).tolist() == piece.encode(text)
    assert [a.table[i] for i in (220, 50256)] == [b" ", b"<|endoftext|>"]


def test_lockstep_finds_every_common_end():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, n + 1)), n)) for _ in "ab")
        x, y = lockstep(a, b, every=int(rng.integers(1, 20)))
        common = np.intersect1d(a, b)
        assert (a[x] == common).all() and (b[y] == common).all() and len(x) == len(common)
    assert [len(z) for z in lockstep(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def brute_alignment(sides, rows):
    plain, _, piece = sides
    a_table, b_table = ByteBpe(A_FILE, True).table, PieceBpe(B_FILE).table
    found, counts = [], Counter()
    for text in rows:
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(a_table[i] for i in a) != whole or b"".join(b_table[i] for i in b) != whole:
            a, b = [], []
        a_end, b_end = (np.cumsum([len(t[i]) for i in x]).tolist() for t, x in ((a_table, a), (b_table, b)))
        a_at, b_at = ({e: i for i, e in enumerate(ends)} for ends in (a_end, b_end))
        groups, links, x, y = [], [], 0, 0
        for e in sorted(set(a_at) & set(b_at)):
            groups.append(",".join(map(str, a[x:a_at[e] + 1])) + "|" + ",".join(map(str, b[y:b_at[e] + 1])))
            links.append((a[a_at[e]], b[b_at[e]]))
            x, y = a_at[e] + 1, b_at[e] + 1
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(a, b, len(g), len(g), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, k in found]


def test_alignment_matches_brute_force(spark, make, sides):
    rows = texts()
    df = make([(i // 2, t, "x", i) for i, t in enumerate(rows)], "doc_id long, text string, n_a string, place int").repartition(3)
    got = {r.place: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
           for r in token_links(df).collect()}
    want = brute_alignment(sides, rows)
    assert [got[i] for i in range(len(rows))] == want
    assert want[6][0] == 0 and want[4][0] > 1           # a mark in the text: no tokens; a special string is plain text
    assert token_links(make([], "doc_id long, text string")).collect() == []
    cuts = align(make([(1, "one two")])).first()
    assert cuts.doc_id == 1 and {len(cuts.a_ids), len(cuts.b_ids)} and bin(cuts.a_ends[0]).count("1") == bin(cuts.b_ends[0]).count("1") > 0


def test_linked_pairs_are_bounded_by_the_vocabularies():
    a, b = [b"", b"a", b"ba", b"c"], [b"a", b"cba", b"c"]
    assert most_pairs(a, b) >= len({(x, y) for x in a for y in b if x and y and (x.endswith(y) or y.endswith(x))})
    assert most_pairs(ByteBpe(A_FILE, True).table, PieceBpe(B_FILE).table) < 1 << 20


def test_differencing_deals_every_item():
    rng = np.random.default_rng(2)
    for _ in range(100):
        sizes = rng.integers(1, 500, int(rng.integers(1, 80)))
        windows = int(rng.integers(1, 20))
        place, sums = differencing(sizes, windows)
        assert (np.bincount(place, sizes, windows) == np.array(sums)).all()
        assert sums.max() - sums.min() <= sizes.max()
    place, sums = differencing(np.array([8, 7, 6, 5, 4]), 2)          # the textbook case: 16 and 14
    assert sorted(sums) == [14, 16]


def test_dealing_raises_the_count_only_when_it_must():
    rows = [(i, 0, 100) for i in range(20)]
    found = deal(rows, 2048, 1)
    assert [sum(n for _, _, n in w) for w in found] == [2000]
    found = deal([(i, 0, 2047) for i in range(5)], 2048, 4)
    assert len(found) >= 5 and all(sum(n for _, _, n in w) <= 2048 for w in found)
    assert sum(n for w in found for _, _, n in w) == 5 * 2047
    assert cut([(1, 10, 7)], 3) == [(1, 10, 2), (1, 12, 2), (1, 14, 3)]
    assert take([(1, 0, 4), (2, 5, 4)], 6) == ([(1, 0, 4), (2, 5, 2)], [(2, 7, 2)])
    assert [sum(n for _, _, n in w) for w in powers([(1, 0, 37)], 16)] == [16, 16, 4, 1]


def test_pack_covers_every_id_once(spark, make, sides):
    rows = texts(5)
    df = make([(i // 2, t, "x", i) for i, t in enumerate(rows)], "doc_id long, text string, start string, place int").repartition(2)
    got = pack(df, windows=4).collect()
    special = sides[1]
    ids = [np.array(special.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in rows]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_id == r.place // 2 and r.doc_tokens == len(ids[r.place])
        assert r.ids == ids[r.place][r.start:r.start + r.length].tobytes()
        pieces[r.place].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, all_ids in enumerate(ids):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(all_ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * total
    assert pack(make([], "doc_id long, text string")).collect() == []


def naive_close(opens):
    stack, close = [], {}
    for i, x in enumerate(opens):
        if x:
            stack.append(i)
        else:
            close[stack.pop()] = i
    return close


def test_parentheses_match_a_stack():
    rng = random.Random(4)
    for size in (1, 2, 31, 32, 33, 500, 3000):
        for chain in (0.1, 0.5, 0.9):
            opens, depth = [], 0
            while len(opens) < 2 * size:
                left = size - sum(opens) if len(opens) < 50 else size - opens_so_far
                if depth == 0 or (left > 0 and rng.random() < chain):
                    opens.append(True)
                    depth += 1
                else:
                    opens.append(False)
                    depth -= 1
                opens_so_far = sum(opens)
                if opens_so_far == size:
                    opens += [False] * depth
                    break
            p = Parentheses(np.array(opens))
            close = naive_close(opens)
            at = np.flatnonzero(p.opens)
            assert p.findclose(at).tolist() == [close[i] for i in at.tolist()]
            leaves, sums = p.subtrees(np.arange(len(at)), np.zeros(len(at), np.int64))
            for k in range(0, len(at), max(1, len(at) // 50)):
                inside = [j for j, i in enumerate(at.tolist()) if at[k] <= i < close[at[k]]]
                assert sums[k] == sum(inside)
                assert leaves[k] == sum(not opens[at[j] + 1] for j in inside)


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = own + sum(saved[k] for k in children[node])
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, depth string"


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        length = rng.choice([0, 1, 2, 3, 12]) if c % 4 else 6
        for t in range(length):
            text = rng.choice(["hello", "é" * 5, "", None, "no"]) if rng.random() < 0.4 else "same"
            rows.append((c, t * 2 if rng.random() > 0.02 else None, rng.choice(["user", "user", None]), text, "x"))
    common = [(c, t, "user", f"copy {t}", "x") for c in range(1000, 1000 + n, 5) for t in range(15)]      # equal conversations
    return rows + common + [(None, 0, "user", "no id", "x"), (7, None, "user", "", "x"), (-3, 0, "user", "negative", "x")]


@pytest.mark.parametrize("seed,n,nodes", [(1, 300, 1 << 20), (2, 200, 7), (3, 3, 1)])
def test_trie_matches_brute_force(spark, make, monkeypatch, seed, n, nodes):
    monkeypatch.setattr(trie_module, "SHARD_NODES", nodes)            # many shards share their spines
    rows = conversations(seed, n)
    # ties in turn go by digest, which brute force does not know: give them one order
    rows = list({(c, t): (c, t, *rest) for c, t, *rest in rows}.values())
    random.Random(0).shuffle(rows)
    got = prefix_trie(make(rows, TURNS).repartition(5)).collect()
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(brute_trie([r[:4] for r in rows]), key=key)


def test_trie_edges(spark, make):
    assert prefix_trie(make([], TURNS)).collect() == []
    one = prefix_trie(make([(4, 0, "user", "a", "x")], TURNS)).collect()
    assert {(r.conv_id, r.n_convs, r.n_leaves) for r in one} == {(4, 1, 1)}
    twice = prefix_trie(make([(5, 0, "user", "a", "x")] * 3 + [(10, 0, "user", "a", "x")] * 3, TURNS)).collect()
    assert sum(r.depth == 0 for r in twice) == 1 and all(r.n_convs >= 1 for r in twice)


def test_long_conversation_spreads_over_ranges(spark, make):
    rows = [(5, i, "user", f"turn {i}", "x") for i in range(4000)] + [(c, 0, "user", "b", "x") for c in range(100, 140)]
    got = {(r.conv_id, r.depth): tuple(r) for r in prefix_trie(make(rows, TURNS)).collect()}
    assert got == {(r[0], r[1]): r for r in brute_trie([r[:4] for r in rows])}
