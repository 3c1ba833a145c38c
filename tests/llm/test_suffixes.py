import hashlib
import random

import numpy as np
from compare import compare, connect
from helpers import docs, odd_docs, with_clashes

from hunkledger.llm import suffixes as sx

COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, size=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - size + 1):
                s = raw[k : k + size]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        if i is not None:
            for k in range(len(raw) - size + 1):
                if first[raw[k : k + size]] < i:
                    gone[k : k + size] = [True] * size
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i is not None, i or 0, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, **options):
    out = sx.dedup(docs(spark, rows), **options)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in out.collect())
    assert got == brute(rows)


def corpus(seed):
    chance = random.Random(seed)
    text = lambda n, alphabet="abcdefghij é": "".join(chance.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (50, 51, 60, 120, 400)] + ["ab" * 60, "z" * 90]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(chance.randrange(1, 5)):
            parts.append(text(chance.randrange(0, 80)))
            if chance.random() < 0.6:
                own = chance.choice(shared)
                at = chance.randrange(len(own))
                parts.append(own[at : at + chance.randrange(40, 130)] if chance.random() < 0.5 else own)
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (None, shared[4]), (104, text(49)), (105, "q" * 300), (106, "q" * 200), (107, "x" + text(3000, "ab"))]
    return rows


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_small_batches_groups_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(sx, "PIECE", 97)
    check(spark, corpus(2), batch_bytes=1500, group_bytes=1000)


def test_kept_bytes(spark):
    line = "this line of more than fifty bytes stands in both documents"
    out = sx.dedup(docs(spark, [(1, line), (2, f"a {line} b")]))
    assert {r["doc_id"]: bytes(r["kept"]) for r in out.collect()} == {1: line.encode(), 2: b"a  b"}


def test_radix_groups_equal_sets():
    chance = np.random.default_rng(1)
    rows = chance.integers(0, 2, size=(500, 21), dtype=np.uint8)
    rows[:, 3:18] = 7
    group = sx.equal_groups(rows)
    names = {}
    assert all(names.setdefault(r.tobytes(), g) == g for r, g in zip(rows, group)) and len(set(names.values())) == len(names)


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    check(spark, rows)
    assert sx.dedup(with_clashes(odd_docs(spark), "kept", "batch")).count() == 8
    assert sx.dedup(odd_docs(spark).limit(0)).count() == 0


def unlike(texts, hot=False):
    raw, base = sx.joined(texts)
    number, first, count, place, anchor = sx.stretches(texts, np.ones(len(texts), dtype=bool), 50, 16)
    ids = np.arange(len(texts))
    return sx.merged(raw, base, ids, number, first, count, place, anchor, np.full(len(number), hot), 50)


def test_equal_pieces_of_a_batch_travel_once():
    passage = bytes(random.Random(3).choices(b"abcdefgh ", k=400))
    alone = len(unlike([passage])[0][0])
    kept, runs, copies = unlike([passage] * 300)
    assert len(kept[0]) == alone and set(kept[0]) == {0} and not len(copies)
    assert runs.tolist() == [[i, 0, 400] for i in range(1, 300)]
    kept, runs, copies = unlike([b" " * 500])
    assert len(kept[0]) == 1 and len(copies) == 450
    # a frequent string in unlike contexts is dealt to many groups
    chance = random.Random(4)
    texts = ["".join(chance.choice("abcdefgh") for _ in range(34)).encode() for _ in range(50)]
    (number, _, count, _, digit), _, _ = unlike([t + b"=" * 16 + t for t in texts], hot=True)
    assert set(count) == {1} and len(set(digit)) == len(number) == 50 * 35


def test_frequent_anchors_are_split(spark):
    chance = random.Random(5)
    word = lambda n: "".join(chance.choice("abc") for _ in range(n))
    shared = word(300)
    rows = corpus(3) + [(200 + i, word(40) + " " * chance.choice((20, 70, 20)) + (shared if i % 3 else word(20)) + " " * 60 + word(9)) for i in range(120)]
    for split in (0, 3, 40):
        check(spark, rows, split=split, batch_bytes=4000, group_bytes=9000)


def test_many_pieces_of_one_anchor(monkeypatch):
    chance = np.random.default_rng(2)
    n = 20_500
    pieces = np.zeros((n, 84), dtype=np.uint8)
    pieces[:, :84] = chance.integers(1, 3, size=(n, 84))
    pieces[:, 34:50] = 7
    windows, before = np.full(n, 35), np.full(n, 34)
    docs_ = np.arange(n)
    gone = sx.repeated(pieces, before, windows, docs_, 50, 16).reshape(n, 35)
    for k in (0, 20, 34):
        seen = set()
        for i in range(n):
            w = pieces[i, k : k + 50].tobytes()
            assert gone[i, k] == (w in seen)
            seen.add(w)


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    ok, n, message = compare(sx.op6_suffix_dedup(spark, sf), connect(sf), sx.ORACLE)
    assert ok and n > 0, message
