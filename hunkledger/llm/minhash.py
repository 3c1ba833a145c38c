"""MinHash near-dedup with BagMinHash signatures.

A text is the multiset of its five-word shingles (lower-cased words between white space; a text of
one to four words is one shingle).  Each shingle's weight, its count, is cut into the intervals
[0,1), [1,2), [2,4), [4,8), ...; every interval is a Poisson process whose points arrive in rising
order, carry a place inside the interval and a random component of the signature, and count only if
their place lies below the weight.  The least point of each component is its signature value, so two
texts agree in a component with the probability of their weighted Jaccard similarity.  Shingles whose next point is
above all minima of their text are done.

Bands of the signature propose pairs: every member of a band's bucket with the bucket's leader.
Verified pairs (multiset overlap counted on the words) join into classes.  Members of one bucket
that are still in different classes are then compared too, so no proposed link is lost: in small buckets pair by
pair, in large ones in blocks, the members outside the bucket's largest class against all, as products of
incidence matrices of which only links leave the task.  Copies and linked members are never expanded into pairs.
The class id is the smallest doc_id of the class.

NULL or blank texts have no shingle: each is its own class.  Rows without doc_id get a NULL class
and take no part.  Rows that repeat a doc_id are one document.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkledger.session import cut_lineage

from .common import in_batches, stage, table

WORDS = 5
LEAST_SIMILARITY = 0.8
#: Bands and rows a band: at similarity 0.8 all bands miss a pair with probability 0.00006.
BANDS, ROWS = 32, 6
#: Buckets up to this size are finished pair by pair, larger ones in blocks of so many members.
PAIRED, BLOCK = 12, 512
#: Shingles of a block whose incidence is held at a time.
SLAB = 4_096
#: Keys that the edges of one node are dealt to.
SALTS = 8
#: Points drawn together in a round.
ROUND_POINTS = 20_000

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the high bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(text: str | None, size: int = WORDS) -> Counter:
    """Multiset of shingles, exact."""
    own = words(text)
    if not own:
        return Counter()
    return Counter(zip(*(own[i:] for i in range(size)))) if len(own) >= size else Counter([tuple(own)])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity; 0 if both are empty."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = a.total() + b.total() - both
    return both / total if total else 0.0


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of words of each text."""
    import xxhash

    known: dict[str, int] = {}
    flat = []
    for own in texts:
        for word in own:
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            flat.append(value)
    return np.array(flat, dtype=np.uint64), np.array([len(t) for t in texts], dtype=np.int64)


def weighted_shingles(texts: list[list[str]], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of each distinct shingle of each text."""
    hashes, lengths = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    n = lengths[owner] if len(owner) else lengths[:0]
    first = np.where(n >= size, place + size <= n, place == 0)
    starts = np.flatnonzero(first)
    value = np.zeros(len(starts), dtype=np.uint64)
    for i in range(size):
        at = np.minimum(starts + i, len(hashes) - 1)
        inside = (starts + i < len(hashes)) & (owner[at] == owner[starts])
        value = mixed(value ^ np.where(inside, hashes[at], np.uint64(i)))
    owner = owner[starts]
    keyed = mixed(value ^ mixed(owner.astype(np.uint64)))
    _, index, count = np.unique(keyed, return_index=True, return_counts=True)
    return owner[index], value[index], count


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int, seed: int = 1) -> np.ndarray:
    """texts x size signature values; a text without shingles has zeros."""
    low, length, key, text, most = [], [], [], [], []
    level, lower = 0, 0
    todo = np.arange(len(owner))
    while len(todo):  # the intervals below each weight
        span = 1 if level == 0 else lower
        low.append(np.full(len(todo), float(lower)))
        length.append(np.full(len(todo), float(span)))
        key.append(mixed(shingle[todo] ^ np.uint64(seed * 1_000_003 + level)))
        text.append(owner[todo])
        most.append(weight[todo].astype(np.float64))
        lower, level = lower + span, level + 1
        todo = todo[weight[todo] > lower]
    if not low:
        return np.zeros((texts, size), dtype=np.uint64)
    low, length, key, text, most = map(np.concatenate, (low, length, key, text, most))
    least = np.full(texts * size, np.inf)
    value = np.zeros(texts * size, dtype=np.uint64)
    time = np.zeros(len(key))
    drawn = 0
    while len(key):
        points = int(min(max(ROUND_POINTS // len(key), 1), 64))
        number = np.arange(drawn + 1, drawn + points + 1, dtype=np.uint64) * _STEP
        first = mixed(key[:, None] + number)
        second = mixed(first)
        at = time[:, None] + np.cumsum(-np.log(unit(first)), axis=1) / (size * length)[:, None]
        component = ((second >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        place = low[:, None] + length[:, None] * (unit(mixed(second)) - 2.0**-53)
        counts = place < most[:, None]
        slot = (text[:, None] * size + component)[counts]
        when, what = at[counts], second[counts]
        np.minimum.at(least, slot, when)
        won = when == least[slot]
        value[slot[won]] = what[won]
        time, drawn = at[:, -1], drawn + points
        open_ = time <= least.reshape(texts, size).max(axis=1)[text]
        low, length, key, text, most, time = (a[open_] for a in (low, length, key, text, most, time))
    return value.reshape(texts, size)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = mixed(np.arange(bands, dtype=np.uint64))[None, :] + np.zeros((len(signature), 1), dtype=np.uint64)
    for r in range(rows):
        out = mixed(out ^ parts[:, :, r])
    return out.view(np.int64)


def _sign_udf(size: int, bands: int, rows: int):
    @F.pandas_udf("key binary, n long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for texts in in_batches(batch, 300_000):
                own = [words(t) for t in texts]
                found = band_hashes(signatures(*weighted_shingles(own, size), len(own), bands * rows), bands, rows)
                for w, hashes in zip(own, found):
                    if w:
                        key = hashlib.md5(" ".join(w).encode("utf-8", "surrogatepass")).digest()
                        out.append((key, max(len(w) - size + 1, 1), hashes))
                    else:
                        out.append((None, 0, []))
            yield pd.DataFrame(out, columns=["key", "n", "bands"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node but the smallest of its component, whose label is that smallest node; by
    alternating large and small stars.

    Every round replaces the edges by fewer and shorter ones and is written to the shared folder;
    rounds grow with the logarithm of the longest chain.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the middle of a large star has very many edges, so they are dealt to several keys
        lower = now.groupBy("a").agg(F.min("b").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        upward = both.filter("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        large = upward.join(lower, ["a", "salt"], "left").select(F.col("b"), F.coalesce("least", "a").alias("low")).toDF("a", "b").filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(joined.select("a", F.col("least").alias("b")))
        now = cut_lineage(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
        before = state


def verified(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs (a, b) whose multiset overlap is high enough.  Each side's text is joined on its own id;
    a text that many pairs need is one row on its side of the join."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, Counter] = ("", Counter())
        for batch in batches:
            kept = []
            for own, other in zip(batch["ta"], batch["tb"]):
                if held[0] != other:
                    held = (other, shingles(other, size))
                kept.append(similarity(shingles(own, size), held[1]) >= least)
            yield batch.loc[kept, ["a", "b"]]

    texted = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    texted = texted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return texted.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long")


def block_links(rows: pd.DataFrame, least: float, size: int) -> list[tuple[int, int]]:
    """Links between the rows of side 0 and of side 1 that have different labels, one for each row of side 0
    and label of side 1.

    The k-th occurrence of a hashed shingle is a column of a 0/1 matrix for each side, and their product counts
    common columns, which is the multiset overlap or, should hashes collide, more.  So no link is missed, and
    what is found is counted again on the words.
    """
    sides = [rows[rows["side"] == side].drop_duplicates("node") for side in (0, 1)]
    (xs, ys), (xl, yl), (xt, yt) = ([part[c].to_numpy() for part in sides] for c in ("node", "label", "text"))
    n = len(xs)
    owner, value, count = weighted_shingles([words(t) for t in (*xt, *yt)], size)
    total = np.bincount(owner, weights=count, minlength=n + len(ys))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner, value = np.repeat(owner, count), mixed(np.repeat(value, count) ^ mixed(nth.astype(np.uint64)))
    column = np.unique(value, return_inverse=True)[1]
    left = owner < n
    both = (np.bincount(column[left], minlength=len(value) + 1) > 0) & (np.bincount(column[~left], minlength=len(value) + 1) > 0)
    some = both[column]
    owner, column, left = owner[some], (np.cumsum(both) - 1)[column[some]], left[some]
    overlap = np.zeros((n, len(ys)), dtype=np.float32)
    for begin in range(0, int(both.sum()), SLAB):
        inside = (column >= begin) & (column < begin + SLAB)
        dense = np.zeros((n + len(ys), SLAB), dtype=np.float32)
        dense[owner[inside], column[inside] - begin] = 1
        overlap += dense[:n] @ dense[n:].T
    near = (overlap >= least * (total[:n, None] + total[None, n:] - overlap) - 1e-6) & (xl[:, None] != yl[None, :])
    found: dict[tuple[int, int], int] = {}
    for i, j in zip(*np.nonzero(near)):
        link = (int(xs[i]), int(yl[j]))
        if link not in found and similarity(shingles(xt[i], size), shingles(yt[j], size)) >= least:
            found[link] = int(ys[j])
    return [(a, b) for (a, _), b in found.items()]


def blocked(rest: DataFrame, texts: DataFrame, least: float, size: int, block: int) -> DataFrame:
    """Links across classes inside large buckets: the members outside the largest class against all members, in
    pairs of blocks."""
    labels = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    major = labels.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    major = major.select("bucket", F.col("top.label").alias("major"), F.ceil(F.col("all") / block).cast("int").alias("right"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("left"))
    rows = rest.join(major, "bucket").join(texts, "node")
    dealt = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = rows.filter("label <> major").select("bucket", dealt(1, "left").alias("i"), every("right").alias("j"), "node", "label", "text", F.lit(0).alias("side"))
    whole = rows.select("bucket", every("left").alias("i"), dealt(2, "right").alias("j"), "node", "label", "text", F.lit(1).alias("side"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(cell, least, size), columns=["a", "b"]).astype("int64")

    return minor.unionByName(whole).groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def long_enough(n, m, least: float):
    """Sizes that still allow the similarity."""
    return (F.least(n, m) >= F.greatest(n, m) * least)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST_SIMILARITY, size: int = WORDS, bands: int = BANDS, rows: int = ROWS, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id: one row for each row of ``docs``."""
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stage(ids.select("doc_id", _sign_udf(size, bands, rows)("text").alias("s")).select("doc_id", "s.*"), "minhash-signed")
    known = signed.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    # one node for each text: its smallest id
    nodes = known.groupBy("key").agg(F.min("doc_id").alias("node"))
    firsts = known.join(nodes, (known["key"] == nodes["key"]) & (known["doc_id"] == nodes["node"])).select("node", "n", "bands")
    in_bucket = firsts.select("node", "n", F.explode("bands").alias("bucket")).distinct()
    leaders = in_bucket.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("members")).filter("members > 1")
    members = stage(in_bucket.join(leaders, "bucket").select("bucket", "node", "n", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n")), "minhash-members")
    involved = members.select("node").distinct()
    texts = ids.join(involved, ids["doc_id"] == involved["node"]).groupBy("node").agg(F.min("text").alias("text"))
    texts = stage(texts, "minhash-texts")
    stars = members.filter((F.col("node") != F.col("leader")) & long_enough(F.col("n"), F.col("leader_n"), least)).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    links = stage(verified(stars, texts, least, size), "minhash-links")
    label = components(links)
    # what the leaders did not join: members of one bucket in different classes; pairs with the leader are done
    classed = members.select("bucket", "node", "n").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = classed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).filter("lo < hi AND members > 2").select("bucket", "members")
    rest = stage(classed.join(split, "bucket"), "minhash-rest")
    few = rest.filter(F.col("members") <= paired).select("bucket", "node", "n", "label")
    left, right = few.toDF("bucket", "a", "an", "al"), few.toDF("bucket", "b", "bn", "bl")
    open_ = left.join(right, "bucket").filter((F.col("a") > F.col("b")) & (F.col("al") != F.col("bl")) & long_enough(F.col("an"), F.col("bn"), least)).select("a", "b").distinct()
    open_ = open_.join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    many = rest.filter(F.col("members") > paired).select("bucket", "node", "label")
    more = stage(verified(open_, texts, least, size).unionByName(blocked(many, texts, least, size, block)), "minhash-more")
    label = components(links.unionByName(more))
    found = known.select("doc_id", "key").join(nodes, "key").select("doc_id", "node").distinct()
    found = found.join(label, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("class_id"))
    return signed.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
