from helpers import by_id, docs, odd_docs, with_clashes

from hunkledger.llm import toxicity as tox
from hunkledger.llm.common import table

SF = "/root/testdata/sf0.1"


def auc(pairs):
    ordered = sorted(pairs)
    ranks, at = {}, 0
    while at < len(ordered):
        end = at
        while end < len(ordered) and ordered[end][0] == ordered[at][0]:
            end += 1
        for i in range(at, end):
            ranks[i] = (at + end + 1) / 2
        at = end
    ones = [ranks[i] for i, (_, y) in enumerate(ordered) if y]
    n1, n0 = len(ones), len(ordered) - len(ones)
    return (sum(ones) - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_auc(spark):
    labels = table(spark, SF, "labels").select("doc_id", "toxic")
    rows = tox.op4_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 300
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.88
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_clauses():
    grammar = tox.Grammar({})
    at = lambda text: {f: v for f, v in zip(tox.FEATURES, grammar.features(text)) if v and "_" in f}
    assert set(at("You are an idiot.")) == {"insult_aimed"}
    assert set(at("What an idiot. You came.")) == {"insult_plain"}
    assert set(at("Idiot, that is you.")) == {"insult_aimed"}
    assert set(at("He is not an idiot.")) == {"insult_negated"}
    assert set(at('She said: "what an idiot"')) == {"insult_reported"}
    assert set(at("They will kill you")) == {"threat_aimed"}
    assert at("nothing to see") == {} and at("") == {} and at(None) == {}


def test_composition_is_complete():
    moves = tox.compose()
    states = {state for state, _ in moves}
    assert all((then, symbol) in moves for then, _ in moves.values() for _, symbol in moves)
    assert len(moves) == 8 * len(states)


def test_odd_rows_and_missing_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon, weights = tox.fit(odd_docs(spark), empty)
    assert lexicon == {} and weights == tox.DEFAULT_WEIGHTS
    out = tox.score(with_clashes(odd_docs(spark), "score"), lexicon, weights)
    got = by_id(out, "score", "predicted")
    assert got[1] == got[2] == got[4] and got[1][0] < 0.5 and out.count() == 8
    assert by_id(tox.score(docs(spark, [(1, "you idiot you moron")]), lexicon, weights), "predicted")[1] == (1,)
    assert tox.score(odd_docs(spark).limit(0), lexicon, weights).count() == 0


def test_learned_stems(spark):
    rows = [(i, f"plain talk zorgu{chr(97 + i % 20)}{chr(97 + i % 7)} more") for i in range(60)] + [(100 + i, "plain talk more") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i, _ in rows], "doc_id long, quality int, toxic int")
    train = docs(spark, rows).join(labels, "doc_id")
    assert "zorgu-" in tox.learn_lexicon(train)
