import hashlib
import random
import re

from helpers import by_id, docs, odd_docs, with_clashes

from hunkledger.llm import pii

# The base patterns as the contract states them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def expected(text):
    spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if counts(k, m.group())]
    told = ",".join("%s:%d:%d" % s for s in spans)
    return (*(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(told.encode()).hexdigest()), set(told.split(",")) - {""}


TEXTS = [
    "a@b.c_d@e.f x@y z@w.v.", "aaa@bbb@c.d +1 (555) 010-9999 and 4111 1111 1111 1111", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 99999999999.1.1.1",
    "card 4111-1111-1111-1111 4111111111111112 5 55", "\U0001f600 é me@x.org \U0001f600 10.0.0.1", "+1........ +12 +1 2 +123456789", "token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f901234567\" end",
    "x" * 3000 + "@a.b", "1 " * 3000, "9" * 4000, "a@" + "b." * 3000 + "c", "+1 (202) 555-0101 then (303) 555-0199", "", None,
]


def model(spark):
    tokens = [f'token = "{hashlib.sha1(bytes([i])).hexdigest()}" and 1234{i} or a{i}@x.org' for i in range(60)]
    return pii.fit(docs(spark, list(enumerate(tokens))))


def test_base_equals_brute_force(spark):
    chance = random.Random(3)
    texts = TEXTS + ["".join(chance.choice("a1.@+- (5)9") for _ in range(chance.randrange(80))) for _ in range(150)]
    out = pii.find(docs(spark, list(enumerate(texts))), pii.Model([], None))
    got = by_id(out, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, text in enumerate(texts):
        want, spans = expected(text)
        assert got[i][:5] == want, text
        assert set(got[i][5].split(",")) - {""} == spans


def test_added_spans_keep_base_ones(spark):
    fitted = model(spark)
    assert fitted.trees and fitted.threshold is not None
    got = by_id(pii.find(docs(spark, list(enumerate(TEXTS))), fitted), "spans", "base_sha256")
    for i, text in enumerate(TEXTS):
        want, spans = expected(text)
        assert got[i][1] == want[4] and spans <= set(got[i][0].split(","))
    assert any(s.startswith("secret:") for s in got[6][0].split(","))


def test_redaction(spark):
    found = pii.find(docs(spark, [(1, "\U0001f600 me@x.org, 10.0.0.1!"), (2, None), (3, "clean")]), pii.Model([], None))
    assert by_id(pii.redact(found), "text") == {1: ("\U0001f600 [EMAIL], [IP]!",), 2: (None,), 3: ("clean",)}


def test_trees_as_columns_equal_the_model(spark):
    text = "x\n  If (feature 0 <= 5.5)\n   Predict: -1.0\n  Else (feature 0 > 5.5)\n   If (feature 3 <= 0.5)\n    Predict: 0.25\n   Else (feature 3 > 0.5)\n    Predict: 2.0\n"
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([tuple([d] + [0, 0, p] + [0] * 5) for d, p in ((1, 1), (9, 0), (9, 1))], ",".join(f"{f} int" for f in pii.FEATURES))
    assert [r[0] for r in rows.select(pii.Model([(0.5, text)], 0.0).margin(F.struct(*pii.FEATURES))).collect()] == [-0.5, 0.125, 1.0]


def test_no_python_in_the_plan(spark):
    plan = pii.find(docs(spark, [(1, "a@b.c")]), model(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(spark):
    assert pii.fit(odd_docs(spark).limit(0)).trees == []
    out = pii.find(with_clashes(odd_docs(spark), "spans", "n_ip"), pii.Model([], None))
    assert out.count() == 8 and out.columns.count("spans") == 1 and "extra" in out.columns
    assert pii.find(odd_docs(spark).limit(0), pii.Model([], None)).count() == 0


def test_threshold_is_the_least_margin_that_is_precise_enough(spark):
    rows = [(i, f"mail user{i}@example.org, order {i % 97:05}, ip 10.0.{i % 256}.{i % 199}, ref 999.{i}.1.{i % 7}") for i in range(400)]
    df = docs(spark, rows)
    model = pii.fit(df)
    kept = df.filter("pmod(xxhash64(text), 4) = 0")
    told = pii.candidates(kept.select("text"), "text")
    told = told.withColumn("b", pii.base_spans()).select(pii.F.inline(pii.F.transform("__c", lambda c: pii.F.struct(c["x"].alias("x"), pii.truth(c, pii.F.col("b")).alias("y")))))
    pairs = sorted(((round(r["m"], 6), r["y"]) for r in told.filter("y IS NOT NULL").select(model.margin(pii.F.col("x")).alias("m"), "y").collect()), reverse=True)
    fits = [m for m in {m for m, _ in pairs} if m > 0 and (own := [y for n, y in pairs if n >= m]) and sum(own) >= 0.95 * len(own)]
    assert fits and abs(model.threshold - min(fits)) < 1e-9
