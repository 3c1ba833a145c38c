"""The pipeline against a version in plain Python on a small corpus."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
from helpers import DOCS

from hunkledger.llm import bpe, minhash
from hunkledger.session import work_path

ITEM = "Which river flows through the old town before it reaches the northern sea at last"
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def corpus():
    chance = random.Random(8)
    prose = lambda n: " ".join("".join(chance.choice("aeioulmnrst") for _ in range(chance.randrange(2, 9))) for _ in range(n))
    rows = [(i, prose(60)) for i in range(20)]
    base = prose(120)
    rows += [(100 + i, base.replace(base.split()[i * 7], "changed", 1)) for i in range(4)]  # near copies
    rows += [(110, rows[3][1]), (111, rows[3][1]), (3, rows[3][1])]  # exact copies, a repeated row
    rows += [(120, prose(20) + " " + ITEM.upper() + "!! " + prose(20)), (121, prose(30) + " " + ITEM[:40])]
    rows += [(130, prose(20) + " write to some.one@mail.example.org now " + prose(10)), (131, None), (132, ""), (133, "12 34 ... !!"), (134, "wörter ñ")]
    return rows


def brute(rows):
    kept = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    own = {}
    for i, t in kept:
        own.setdefault(i, t)
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in own:
        for j in own:
            if j < i and minhash.similarity(minhash.shingles(own[i]), minhash.shingles(own[j])) >= 0.8:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    own = {i: t for i, t in own.items() if root(i) == i}
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    own = {i: t for i, t in own.items() if norm(ITEM) not in norm(t)}
    enc = bpe.encoding(bpe.default_ranks())
    out = {}
    for i, t in own.items():
        clean = MAIL.sub("[EMAIL]", t)
        ids = enc.encode_ordinary(clean)
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    return out


def test_run_equals_brute_force(spark):
    rows = corpus()
    sf_dir = work_path(spark, "sf")
    full = [(i, t, "xx" if i % 2 else None, "s", len(t) if t else None) for i, t in rows]
    spark.createDataFrame(full, DOCS).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == brute(rows)
    assert {120, 131, 132, 133, 101, 110}.isdisjoint(got) and {3, 100, 121, 130, 134} <= set(got)


def test_unlike_texts_of_one_id_all_stay(spark):
    prose = corpus()
    one, other, copy = prose[0][1], prose[1][1], prose[2][1]
    rows = [(1, one), (1, other), (1, other), (2, copy), (3, copy), (None, one), (None, one)]
    full = [(i, t, "xx", "s", len(t)) for i, t in rows]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(full, DOCS), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, one), (1, other), (2, copy), (0, one), (0, one)])


def test_stages_keep_the_columns_of_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "decontamination", "PII", "byte-level BPE"]
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, sf_dir).columns == columns


def test_empty_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, docs, "/root/testdata/sf0.001").count() == 0
