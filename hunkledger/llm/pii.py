"""PII by candidate gradient boosting, in DataFrame functions only.

Seven generators propose spans that may overlap: the four base kinds (email, ip, card, phone), and secrets, local
phone numbers and long numbers.  Each candidate becomes a vector of format and context features.
Boosted trees, trained on candidates whose truth the validators tell (a valid base match and what lies in it is
private; a match that fails its validator, or a short number, is not), score the rest.  The least threshold that
reaches ``PRECISION`` on texts kept out of training selects the spans to add; base spans always stay.

Training counts the feature vectors of all candidates of all documents; the trees are fitted on at most
``TRAIN_PATTERNS`` distinct vectors, weighted by their counts.  The threshold comes from the running precision over all
margins, one row for each distinct margin (a sum of leaves, rounded to six digits).  The trees then are plain column expressions, so
scoring happens in each document's row, without shuffle or join.

Places are code points, ends exclusive.  NULL texts count as empty.  Repeated rows each get a result; extra
columns pass through, one named like a result column is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hunkledger.functions import arrays

from .common import stage, table

TRAIN_PATTERNS = 20_000
TREES, DEPTH = 20, 3
PRECISION = 0.95
#: One text in so many is kept out of training, to set the threshold.
CALIBRATION = 4

# What a base match is.  A run of characters is entered only at its start or where the match
# before it ended, and is never given back, so that long runs take linear time; the matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
# The method's own kinds.
SECRET = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\"']?[\x20]?[:=][\x20]?[\"']?[A-Za-z0-9+/_-]{8,}+"
TEL = r"(?<![0-9])\(?[0-9]{2,4}+\)?[\x20.-][0-9]{3,4}+[\x20.-][0-9]{3,4}+(?![0-9])"
NUMBER = r"(?<![A-Za-z0-9])[0-9]{5,15}+(?![A-Za-z0-9])"
KINDS = (*BASE, "secret", "tel", "number")
PATTERNS = (EMAIL, IP, CARD, PHONE, SECRET, TEL, NUMBER)
KEYWORD = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|iban|account|ssn|passport|ip|host|mail|token|secret|key|password|pwd|id)\W*$"

FEATURES = ("digits", "letters", "separators", "plus", "paren", "variety", "before", "after", "keyword")
_CANDIDATE = "array<struct<s:int,e:int,v:string,pre:string,post:string>>"
_FOUND = "array<struct<k:int,s:int,e:int,ok:boolean,x:struct<" + ",".join(f"{f}:int" for f in FEATURES) + ">>>"


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once a row, however often it is used."""
    return rows.select("*", arrays.held(value).alias(name))


def gate(kind: str, text: Column) -> Column:
    """Whether a text can hold the kind at all; spares most texts the patterns."""
    digits = text.rlike("[0-9]")
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "phone": F.contains(text, F.lit("+")),
        "secret": text.rlike("[:=]"),
    }.get(kind, digits)


def located(parts: Column, hits: Column) -> Column:
    """Start, end, value and neighbourhood of each match, from the texts between matches and the matches."""

    def step(state: Column, i: Column) -> Column:
        gap, hit = F.get(parts, i - 1), F.get(hits, i - 1)
        start = state["at"] + F.length(gap)
        end = start + F.length(hit)
        found = F.struct(start.alias("s"), end.alias("e"), hit.alias("v"), F.right(gap, F.lit(24)).alias("pre"), F.left(F.get(parts, i), F.lit(1)).alias("post"))
        return F.struct(end.alias("at"), F.array_append(state["out"], found).alias("out"))

    numbers = F.when(F.size(hits) > 0, F.sequence(F.lit(1), F.size(hits))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_CANDIDATE).alias("out"))
    return F.aggregate(numbers, begin, step, lambda state: state["out"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What makes a base match count; false for the kinds of the method."""
    digits = digits_of(value)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(False)


def char_class(char: Column) -> Column:
    """0 nothing or white space, 1 letter, 2 digit, 3 other."""
    return (
        F.when(F.coalesce(char, F.lit("")).rlike(r"^\s?$"), 0).when(char.rlike(r"^\p{L}$"), 1).when(char.rlike("^[0-9]$"), 2).otherwise(3)
    )


def features(c: Column) -> Column:
    """Format and context of a candidate as small integers, so that equal vectors can be counted."""
    value = c["v"]
    digits = digits_of(value)
    values = {
        "digits": F.least(F.length(digits), F.lit(40)),
        "letters": F.least(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(40)),
        "separators": F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(12)),
        "plus": value.startswith("+").cast("int"),
        "paren": F.contains(value, F.lit("(")).cast("int"),
        "variety": F.size(F.array_distinct(F.split(digits, ""))),
        "before": char_class(F.right(c["pre"], F.lit(1))),
        "after": char_class(c["post"]),
        "keyword": c["pre"].rlike(KEYWORD).cast("int"),
    }
    return F.struct(*(values[f].cast("int").alias(f) for f in FEATURES))


def _described(number: int, matches: Column) -> Column:
    """The matches of one generator with what the later steps need of them."""
    describe = lambda c: F.struct(F.lit(number).alias("k"), c["s"].alias("s"), c["e"].alias("e"), valid(KINDS[number], c["v"]).alias("ok"), features(c).alias("x"))
    return F.transform(matches, describe).cast(_FOUND)


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """Add ``__c``: every generator's matches with kind, place, validity and features."""
    own = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<string>")
    cut = []
    for number, (kind, pattern) in enumerate(zip(KINDS, PATTERNS)):
        may = gate(kind, own)
        cut.append(F.when(may, F.split(own, pattern, -1)).otherwise(empty).alias(f"p{number}"))
        cut.append(F.when(may, F.regexp_extract_all(own, F.lit(pattern), F.lit(0))).otherwise(empty).alias(f"h{number}"))
    rows = held(docs, "__cut", F.struct(*cut))
    found = [_described(number, located(F.col(f"__cut.p{number}"), F.col(f"__cut.h{number}"))) for number in range(len(KINDS))]
    return held(rows.withColumn("__all", F.concat(*found)).drop("__cut"), "__c", F.col("__all")).drop("__all")


def overlaps(c: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"]))


def base_spans(c: str = "__c") -> Column:
    return F.filter(c, lambda x: x["ok"])


def truth(c: Column, base: Column) -> Column:
    """1 private, 0 not, NULL unknown."""
    x = c["x"]
    secret = (c["k"] == KINDS.index("secret")) & (x["digits"] >= 4) & (x["digits"] + x["letters"] >= 20)
    short = (c["k"] == KINDS.index("number")) & (x["digits"] < 8)
    return (
        F.when(c["ok"] | overlaps(c, base) | secret, F.lit(1)).when((c["k"] < len(BASE)) | short, F.lit(0)).otherwise(F.lit(None).cast("int"))
    )


def tree_column(text: str, x: Column) -> Column:
    """A regression tree, as its printed form tells it, as nested conditions."""
    lines = [l.strip() for l in text.splitlines() if re.match(r"\s*(If|Else|Predict)", l)]

    def read(at: int) -> tuple[Column, int]:
        if lines[at].startswith("Predict"):
            return F.lit(float(lines[at].split(":")[1])), at + 1
        number, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        low, at = read(at + 1)
        high, at = read(at + 1)  # steps over "Else"
        return F.when(x[FEATURES[int(number)]] <= float(limit), low).otherwise(high), at

    return read(0)[0]


class Model:
    """Boosted trees, their weights and the threshold on their margin; the margin is a column of the features."""

    def __init__(self, trees: list[tuple[float, str]], threshold: float | None):
        self.trees, self.threshold = trees, threshold

    def margin(self, x: Column) -> Column:
        total = F.lit(0.0)
        for weight, text in self.trees:
            total = total + F.lit(weight) * tree_column(text, x)
        return total

    def selects(self, x: Column) -> Column:
        return self.margin(x) >= self.threshold if self.trees and self.threshold is not None else F.lit(False)


def fit(docs: DataFrame, text: str = "text", patterns: int = TRAIN_PATTERNS, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Model:
    """Trees from the counted candidates of all documents, and the least margin that is precise enough.

    Without both truths among the candidates nothing can be learned, and nothing is added.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = candidates(docs.select(F.col(text).alias("text"), (F.pmod(F.xxhash64(text), F.lit(CALIBRATION)) == 0).alias("kept")), "text").drop("text")
    told = held(rows.withColumn("__b", base_spans()), "__t", F.transform("__c", lambda c: F.struct(c["x"].alias("x"), truth(c, F.col("__b")).alias("y"))))
    told = told.select(F.coalesce("kept", F.lit(False)).alias("kept"), F.explode("__t").alias("t")).select("kept", "t.x.*", "t.y").filter("y IS NOT NULL")
    counted = stage(told.groupBy("kept", "y", *FEATURES).agg(F.count("*").cast("double").alias("n")), "pii-patterns")
    train = counted.filter("NOT kept").orderBy(F.desc("n"), "y", *FEATURES).limit(patterns)
    if len(train.select("y").distinct().take(2)) < 2:
        return Model([], None)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train.coalesce(1)).withColumn("label", F.col("y").cast("double"))
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, weightCol="n", seed=7, maxBins=64).fit(vectors)
    model = Model([(float(w), t.toDebugString) for w, t in zip(fitted.treeWeights, fitted.trees)], None)
    x = F.struct(*FEATURES)
    margins = counted.filter("kept").withColumn("m", F.round(model.margin(x), 6)).groupBy("m").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("hits"))
    # the least margin down to which the share of private ones is high enough; the driver gets that one number
    down = Window.orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)
    running = margins.select("m", F.sum("n").over(down).alias("seen"), F.sum("hits").over(down).alias("right"))
    model.threshold = running.filter((F.col("right") >= precision * F.col("seen")) & (F.col("m") > 0)).agg(F.min("m")).first()[0]
    return model


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


_ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "pii")


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add counts and hash of the base spans, ``spans`` as text, and ``pii``, the spans as structs (kind number,
    start, end), by kind and start."""
    rows = candidates(docs.drop(*_ADDED), text)
    place = lambda spans: F.array_sort(F.transform(spans, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))))
    base = base_spans()
    added = F.filter("__c", lambda c: ~c["ok"] & ~overlaps(c, F.col("__b")) & model.selects(c["x"]))
    rows = held(rows.withColumn("__b", base), "__s", F.struct(place(F.col("__b")).alias("b"), place(F.concat("__b", added)).alias("a")))
    kinds = F.transform("__s.b", lambda c: c["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(BASE)]
    return rows.select(
        *docs.drop(*_ADDED).columns, *counts, F.sha2(text_of(F.col("__s.b")), 256).alias("base_sha256"),
        text_of(F.col("__s.a")).alias("spans"), F.col("__s.a").alias("pii"),
    )


def redact(docs: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace every span in the text by its kind in brackets; of overlapping ones the first, then longest."""
    ordered = F.array_sort(F.transform(pii, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e"), c["k"].alias("k"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(state: Column, c: Column) -> Column:
        fresh = c["s"] >= state["at"]
        piece = F.substring(F.col(text), state["at"] + 1, c["s"] - state["at"])
        end = F.greatest(-c["e"], state["at"])
        out = F.when(fresh, F.concat(state["out"], F.array(piece, F.get(names, c["k"])))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(ordered, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(text), s["at"] + 1, F.length(text))))
    return docs.withColumn(text, F.when(F.size(pii) > 0, clean).otherwise(F.col(text)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
