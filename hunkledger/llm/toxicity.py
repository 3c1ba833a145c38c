"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, report, clause end, other.  Small
transducers follow negation (its scope is a few words), target and reported speech within a clause;
their product reads a clause once and writes, at every insult or threat, how it stands: plain,
aimed at somebody, negated or reported.  A text is scored by its matched clauses, through weights that a
logistic regression learns; a word outside a clause pattern adds nothing.

Insults are the seed words and the words or word beginnings that occur significantly more often in
toxic training texts.  Lexicon and weights come from different folds, so that a word that fits the first
by chance gets no credit.  Both are fitted on at most ``TRAIN_ROWS`` labelled rows.

NULL or empty texts get the score of a text without a match.  Labels that are NULL are not learned
from; without both labels in the training rows the weights are the defaults below.  Repeated rows each
get a result; extra columns pass through, columns named score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held_out, stage, table

#: Bound of the labelled sample, picked by a hash of the id.
TRAIN_ROWS = 20_000
#: Most entries of the learned lexicon.
LEXICON_SIZE = 5_000
#: A learned entry is in so many toxic training texts, and its log-likelihood ratio is so high.
LEAST_TEXTS, LEAST_RATIO = 4, 16.0
#: Lengths of word beginnings that may be learned.
STEMS = (4, 5, 6, 7, 8)
#: Words that a negation reaches.
SCOPE = 3
FLUSH = 200_000

# Seed words of the grammar.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown vermin imbecile idiota estúpido estúpida basura imbécil idiote stupide ordure dumm dummkopf abschaum trottel".split()
THREATS = "kill hurt destroy beat punch stab shoot murder töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your you're u he she they them him dich dir euch du vous toi tú usted ustedes".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine niemals pas jamais ne nunca jamás".split()
REPORTS = "said says told wrote called claimed reported quoted sagte sagt schrieb dit disait écrit dijo dice escribió".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
QUOTES = frozenset('"“”«»')

STANDINGS = ("plain", "aimed", "negated", "reported")
FEATURES = [f"{what}_{how}" for what in ("insult", "threat") for how in STANDINGS] + ["weight", "strongest", "share"]
#: Weights without training rows: intercept first.
DEFAULT_WEIGHTS = [-2.5, 2.0, 3.0, 0.5, 0.5, 1.0, 2.5, 0.2, 0.2, 0.3, 0.1, 1.0]


def negation(state: int, symbol: str) -> int:
    """Words that the scope still covers."""
    return SCOPE if symbol == "negation" else 0 if symbol == "end" else max(0, state - 1)


def target(state: int, symbol: str) -> int:
    return 1 if symbol == "target" else 0 if symbol == "end" else state


def report(state: int, symbol: str) -> int:
    """1 after a reporting verb, 2 inside its quotation; a clause end closes only the first."""
    if symbol == "report":
        return max(state, 1)
    if symbol == "quote":
        return {0: 0, 1: 2, 2: 0}[state]
    return 0 if symbol == "end" and state == 1 else state


def standing(state: tuple[int, int, int]) -> str:
    negated, aimed, reported = state
    return "reported" if reported else "negated" if negated else "aimed" if aimed else "plain"


def compose() -> dict[tuple[tuple[int, int, int], str], tuple[tuple[int, int, int], str | None]]:
    """Product of the transducers: (state, symbol) to (next state, standing written or None)."""
    table = {}
    symbols = ("insult", "threat", "target", "negation", "report", "quote", "end", "other")
    todo = [(0, 0, 0)]
    seen = set(todo)
    while todo:
        state = todo.pop()
        for symbol in symbols:
            then = (negation(state[0], symbol), target(state[1], symbol), report(state[2], symbol))
            table[state, symbol] = (then, standing(state) if symbol in ("insult", "threat") else None)
            if then not in seen:
                seen.add(then)
                todo.append(then)
    return table


class Grammar:
    """Lexicon and composed transducer; kept small enough to travel with a task."""

    def __init__(self, learned: dict[str, float]):
        self.symbol = {w: s for s, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
        self.weight = {w: 3.0 for w in INSULTS} | learned
        self.moves = compose()
        self.known: dict[str, float] = {}

    def strength(self, word: str) -> float:
        """Weight of an insult or of its longest known beginning, else 0."""
        found = self.known.get(word)
        if found is None:
            weight = self.weight
            found = weight.get(word, 0.0) or max(weight.get(f"{word[:n]}-", 0.0) if len(word) > n else 0.0 for n in STEMS)
            if len(self.known) > FLUSH:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        out = [0.0] * len(FEATURES)
        words = _WORD.findall((text or "").lower())
        strength, symbol = self.strength, self.symbol
        if not any(strength(w) or symbol.get(w) == "threat" for w in set(words)):
            return out
        counts: Counter[tuple[str, str]] = Counter()
        total = strongest = 0.0
        state = (0, 0, 0)
        # an aim may follow its insult, so a clause's plain matches become aimed if it ends with a target
        waiting: Counter[str] = Counter()
        for match in _TOKEN.finditer(text.lower()):
            token = match.group()
            if token in QUOTES:
                kind = "quote"
            elif not token[0].isalpha():
                kind = "end"
            else:
                kind = symbol.get(token) or ("insult" if strength(token) else "other")
            if kind == "target" or kind == "end":
                for what, n in waiting.items():
                    counts[what, "aimed" if kind == "target" else "plain"] += n
                waiting.clear()
            state, how = self.moves[state, kind]
            if how == "plain":
                waiting[kind] += 1
            elif how:
                counts[kind, how] += 1
            if kind == "insult":
                scale = 1.0 if how in ("plain", "aimed") else 0.5
                total += scale * strength(token)
                strongest = max(strongest, scale * strength(token))
        for what, n in waiting.items():
            counts[what, "plain"] += n
        for i, (what, how) in enumerate((w, h) for w in ("insult", "threat") for h in STANDINGS):
            out[i] = math.log1p(counts[what, how])
        out[-3], out[-2] = math.log1p(total), strongest
        out[-1] = math.log1p(1000 * sum(counts.values()) / max(len(words), 1))
        return out


def count_words(rows: DataFrame) -> DataFrame:
    """word, n_toxic, n_clean: how many texts of each label hold each word or word beginning (``-``)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            words = list(toxic.keys() | clean.keys())
            out = pd.DataFrame({"word": words, "n_toxic": [toxic[w] for w in words], "n_clean": [clean[w] for w in words]})
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                words = set(_WORD.findall((text or "").lower()))
                words |= {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}
                (toxic if label else clean).update(words)
                if len(toxic) + len(clean) > FLUSH:
                    yield flush()
        if toxic or clean:
            yield flush()

    counted = rows.select("text", "toxic").mapInPandas(add, "word string, n_toxic long, n_clean long")
    return counted.groupBy("word").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """The ``size`` most telling words with their log odds."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    share = n1 / (n1 + n0)
    a, b = F.col("n_toxic"), F.col("n_clean")
    both = a + b
    ratio = 2 * (a * F.log(a / (both * share)) + F.when(b > 0, b * F.log(b / (both * (1 - share)))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    telling = (
        count_words(rows).filter((a >= LEAST_TEXTS) & (a / both > share) & (ratio >= LEAST_RATIO))
        .select("word", odds.alias("odds"), ratio.alias("ratio")).filter("odds > 1").orderBy(F.desc("ratio"), "word").limit(size)
    )
    return {r["word"]: float(r["odds"]) for r in telling.collect()}


def learn_weights(rows: DataFrame, grammar: Grammar) -> list[float]:
    """Intercept and weight of each feature, by logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return DEFAULT_WEIGHTS

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(grammar.features)

    seen = stage(rows.select(F.col("toxic").cast("double").alias("label"), features("text").alias("f")), "toxicity-features")
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(seen.select("label", array_to_vector("f").alias("features")))
    return [float(model.intercept), *map(float, model.coefficients)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lexicon_size: int = LEXICON_SIZE) -> tuple[dict[str, float], list[float]]:
    """Lexicon and weights from labelled texts.  ``docs``: doc_id, text; ``labels``: doc_id, toxic.

    The label sample has at most ``rows`` rows, so it is small enough to be sent to every task, and
    no text is shuffled.
    """
    sample = labels.select("doc_id", "toxic").dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    train = stage(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "toxicity-train")
    lexicon = learn_lexicon(train.filter(fold(F.col("doc_id")) <= 3), lexicon_size)
    return lexicon, learn_weights(train.filter(fold(F.col("doc_id")) > 3), Grammar(lexicon))


def score(docs: DataFrame, lexicon: dict[str, float], weights: list[float], text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on)."""
    first, rest = weights[0], np.array(weights[1:])
    grammar = Grammar(lexicon)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([grammar.features(t if isinstance(t, str) else None) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(first + found @ rest, -60, 60))))

    return docs.drop("score", "predicted").withColumn("score", run(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 0)
    lexicon, weights = fit(docs, labels)
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return score(rows, lexicon, weights).select("doc_id", "held_out", "score", "predicted")
