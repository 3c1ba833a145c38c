import hashlib
import zlib
from collections import Counter

import pytest
from compare import compare, connect
from helpers import DOCS, by_id, docs, odd_docs, with_clashes

from hunkledger.llm import merkle

SF = "/root/testdata/sf0.001"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(row, lowered=False):
    doc_id, text, lang, source, n_chars = row
    if lowered and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    told = (doc_id, source, lang, n_chars, text)
    return digest(*("-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}" for v in told))


def runs(items):
    return [items[i : i + 16] for i in range(0, len(items), 16)]


def folds(items, leaf_at):
    """(root of the items, siblings on the way from one place) by plain loops."""
    siblings = []
    while len(items) > 1:
        own = items[leaf_at // 16 * 16 :][:16]
        siblings += own[: leaf_at % 16] + own[leaf_at % 16 + 1 :]
        items, leaf_at = [digest(*run) for run in runs(items)], leaf_at // 16
    return items[0], siblings


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources}
    plain = {s: [leaf_of(r) for r in own] for s, own in order.items()}
    subroots = [folds(plain[s], 0)[0] for s in sources]
    root = folds(subroots, 0)[0]
    out = []
    for number, s in enumerate(sources):
        for at, row in enumerate(order[s]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            changed = plain[s][:at] + [leaf_of(row, hit)] + plain[s][at + 1 :]
            path = folds(plain[s], at)[1] + folds(subroots, number)[1]
            above = subroots[:number] + [folds(changed, at)[0]] + subroots[number + 1 :]
            folded = folds(above, number)[0]
            out.append((row[0], plain[s][at], subroots[number], root, digest(*path), folded, folded == root))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in merkle.verify(merkle.build(df)).collect())


def made(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def row(i, text, source, lang="en"):
    return (i, text, lang, source, len(text) if text is not None else None)


def test_oracle(spark):
    ok, n, message = compare(merkle.op12_merkle(spark, SF), connect(SF), merkle.ORACLE)
    assert ok and n == 200, message


@pytest.mark.parametrize("a_copy", [4096, 2])
def test_several_levels_ties_and_nulls(spark, monkeypatch, a_copy):
    monkeypatch.setattr(merkle, "RUNS_A_COPY", a_copy)
    rows = [row(i * 7 - 100, f"Text {i} É", "hot") for i in range(530)]
    rows += [row(i, "Some", f"s{i % 19}") for i in range(40)] + [row(1, "lone", "Z"), row(2, "LONE", "é")]
    rows += [row(None, None, None, None), row(None, "A", None), row(5, "", "hot"), row(5, "same id", "hot"), row(5, "same id", "hot")]
    assert found(made(spark, rows).repartition(5)) == brute(rows)


@pytest.mark.parametrize("n", [1, 17, 257])
def test_one_source(spark, n):
    rows = [row(i, f"Doc {i}", "only") for i in range(n)]
    assert found(made(spark, rows)) == brute(rows)


def test_lone_leaves_of_many_sources(spark):
    rows = [row(i, "Same", f"source {i:03}") for i in range(40)]
    assert found(made(spark, rows)) == brute(rows)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [row(None, "Same", "s")] * 50 + [row(None, f"other {i}", "s") for i in range(20)]
    assert found(made(spark, rows)) == brute(rows)


def test_odd_rows_long_text_and_clashing_columns(spark):
    df = odd_docs(spark).unionByName(docs(spark, [(70, "Long " * 100_000)]))
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    clashing = with_clashes(df, "leaf", "root", "seq", "part", "place", "run", "proof", "number", "row")
    assert found(clashing) == found(df) == brute(rows)


def test_empty_table(spark):
    empty = merkle.verify(merkle.build(docs(spark, [])))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_tampering_is_told_and_the_row_limit_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = by_id(merkle.verify(merkle.build(docs(spark, [(i, "Upper") for i in range(40)] + [(i, "lower") for i in range(40, 60)]))), "verified")
    assert {i for i, (ok,) in got.items() if not ok} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
