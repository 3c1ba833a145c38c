import random

import numpy as np
from helpers import by_id, docs, odd_docs, with_clashes

from hunkledger.llm import minhash as mh


def brute(rows, least=0.8):
    """Classes of the graph of all pairs that are similar enough."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = {}
    for i, t in rows:
        own.setdefault(i, mh.shingles(t))
    for i, a in own.items():
        for j, b in own.items():
            if j < i and mh.similarity(a, b) >= least:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i),) for i in own}


def corpus(seed=1):
    chance = random.Random(seed)
    word = lambda: f"w{chance.randrange(400)}"
    rows = []
    for base in range(12):
        own = [word() for _ in range(chance.randrange(30, 150))]
        for _ in range(chance.randrange(1, 9)):
            copy = own[:]
            for _ in range(chance.randrange(0, max(2, len(own) // 25))):
                copy[chance.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
        own[: len(own) // 60] = []
    rows += ["common line of ten words that many texts do share"] * 20 + ["a b", "A  b", "a b c", "solo"]
    # a chain: each is near the next one only
    chain = [f"c{i}" for i in range(160)]
    rows += [" ".join(chain[s : s + 100]) for s in range(0, 60, 6)]
    chance.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    assert by_id(mh.near_duplicates(docs(spark, rows)), "class_id") == brute(rows)


def test_odd_rows(spark):
    out = mh.near_duplicates(with_clashes(odd_docs(spark), "class_id", "key"))
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in out.collect()) == [(False, 1, 1), (False, 2, 2), (False, 3, 3), (False, 4, 4), (False, 4, 4), (False, 5, 5), (False, 6, 6), (True, 0, None)]
    assert mh.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299) if i != 150], "a long, b long")
    got = {r["node"]: r["label"] for r in mh.components(edges).collect()}
    assert got == {n: min(part) for part in (order[:151], order[151:]) for n in part if n != min(part)}
    assert mh.components(edges.limit(0)).count() == 0


def test_signatures_are_unbiased():
    a = " ".join(["x"] * 100 + [f"a{i}" for i in range(50)])
    b = " ".join(["x"] * 63 + [f"a{i}" for i in range(25)] + [f"b{i}" for i in range(25)])
    want = mh.similarity(mh.shingles(a), mh.shingles(b))
    rates = []
    for seed in range(1, 31):
        s = mh.signatures(*mh.weighted_shingles([mh.words(a), mh.words(b), []]), 3, 192, seed)
        rates.append(float((s[0] == s[1]).mean()))
        assert not s[2].any()
    assert abs(np.mean(rates) - want) < 4 * np.std(rates) / len(rates) ** 0.5 + 1e-9


def test_weighted_shingles_equal_the_counter():
    texts = [mh.words("a b c d e a b c d e a b c d e"), mh.words("one two"), [], mh.words("p q r s t u")]
    owner, _, count = mh.weighted_shingles(texts)
    for i, own in enumerate(texts):
        assert sorted(count[owner == i]) == sorted(mh.shingles(" ".join(own)).values())


def test_blocks_of_large_buckets(spark):
    rows = corpus(3)
    got = by_id(mh.near_duplicates(docs(spark, rows), paired=2, block=4), "class_id")
    assert got == brute(rows)
