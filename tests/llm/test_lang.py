from helpers import by_id, docs, odd_docs, with_clashes

from hunkledger.llm import lang
from hunkledger.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    found = lang.op8_language_id(spark, SF)
    truth = table(spark, SF, "documents").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    train = docs(spark, [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "no lang", None)])
    prototypes = lang.fit(train)
    assert list(prototypes) == ["de", "en"]
    out = lang.predict(with_clashes(odd_docs(spark), "score", "lang_pred"), prototypes)
    assert out.columns.count("score") == 1 and out.count() == 8
    got = by_id(out, "lang_pred", "score")
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in ("de", "en")
    same = by_id(lang.predict(train, prototypes), "lang_pred")
    assert same[1] == ("en",) and same[2] == ("de",)


def test_no_training_rows(spark):
    empty = odd_docs(spark).limit(0)
    assert lang.fit(empty) == {}
    assert {r["lang_pred"] for r in lang.predict(odd_docs(spark), {}).collect()} == {"und"}
    assert lang.predict(empty, {}).count() == 0


def test_counts_equal_a_loop():
    texts = ["Ab, c!", "", "éa", "..x..y", "1 2", " the end", "tail"]
    there, counts = lang.gram_counts(texts)
    code = lang.symbols()
    for text, row in zip(texts, counts):
        own = [0]
        for char in text.lower() + " ":
            if code[ord(char)] or own[-1]:
                own.append(int(code[ord(char)]))
        grams = [a * lang.SYMBOLS**2 + b * lang.SYMBOLS + c for a, b, c in zip(own, own[1:], own[2:])]
        assert {g: int(n) for g, n in zip(there, row) if n} == {g: grams.count(g) for g in grams}
