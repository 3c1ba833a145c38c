"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared as streams of lower-cased letters and digits, every run of
anything else being one space.  An item of length L that stands in a text with at most k edits
shares at least L - q + 1 - q*k of its q-grams with it, all on diagonals (place in the text less place
in the item) within k of each other.  So shared q-grams are counted in overlapping bands of
diagonals, 2*(k + 1) wide; only bands that reach the bound are aligned, inside the band.

A document is contaminated by an item if the whole item stands in it within its edit budget,
``EDIT_RATE`` of its length.  Items below ``LEAST_ITEM`` characters, which a few edits would turn into another text,
match verbatim (after normalisation) at word boundaries.  Items that are NULL or hold no letter or digit match
nothing, nor do NULL or empty texts.  Repeated items and rows are each reported.
Of several places of an item in a text, the one with fewest edits is reported, then the first.

The items are laid into blocks of at most ``BLOCK_CHARS`` characters; each block's index travels to the
tasks, one pass over the texts a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table

Q = 10
EDIT_RATE = 0.08
LEAST_ITEM = 40
BLOCK_CHARS = 4_000_000
#: Bits of the first filter; a block of items sets a few hundredths of it.
TABLE_BITS = 22

_BASE = 0x9E3779B97F4A7C15 | 1
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
SPACE, EDGE = 32, 0


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Lower-case code point of each letter or digit, a space for everything else."""
    out = np.full(0x110000, SPACE, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalnum():
            lower = char.lower()
            out[point] = ord(lower) if len(lower) == 1 else point
    return out


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of all texts with an edge between two of them; each one's place in the
    joined input; where each text begins in the joined input."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)))
    code = folded()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    code[begins[1:] - 1] = EDGE
    before = np.concatenate(([EDGE], code[:-1]))
    kept = np.flatnonzero((code != SPACE) | ((before != SPACE) & (before != EDGE)))
    return code[kept], kept, begins


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every q-gram, built from halves."""
    code = code.astype(np.uint64)
    with np.errstate(over="ignore"):
        power = {1: np.uint64(_BASE)}
        have = {1: code}
        length = 1
        while length * 2 <= q:
            half = have[length]
            have[length * 2] = half[:-length] * power[length] + half[length:] if len(half) > length else half[:0]
            power[length * 2] = power[length] * power[length]
            length *= 2
        out, done = have[length], length
        for part in sorted(have, reverse=True):
            while done + part <= q:
                n = max(len(code) - done - part + 1, 0)
                out = out[:n] * power[part] + have[part][done : done + n]
                done += part
    return out


class Index:
    """q-grams of a block of items: sorted hashes, and for each the items and places it occurs at."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q, rate: float = EDIT_RATE, least: int = LEAST_ITEM):
        self.q = q
        self.ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        short: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for item_id, text in items:
            code = normal([text])[0]
            code = code[code != EDGE]
            code = code[:-1] if len(code) and code[-1] == SPACE else code
            if len(code) >= max(least, q):
                self.ids.append(item_id)
                self.codes.append(code)
            elif len(code):
                short.setdefault(len(code), []).append((item_id, code))
        #: For each length of short items their sorted hashes, and ids and codes in the same order.
        self.short = {}
        for size, own in short.items():
            hashes = np.array([gram_hashes(c, size)[0] for _, c in own], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.short[size] = hashes[order], [own[i] for i in order]
        length = np.array([len(c) for c in self.codes], dtype=np.int64)
        # beyond (L - q) / q edits the lemma promises no shared q-gram
        self.budget = np.minimum((length * rate).astype(np.int64), (length - q) // q)
        self.bound = length - q + 1 - q * self.budget
        self.length = length
        hashes = [gram_hashes(c, q) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else flat.astype(np.int64)
        self.seen = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.seen[self.slot(self.hashes)] = True

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _SPREAD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def shared(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the texts, item, place in the item) of each shared q-gram."""
        hashes = gram_hashes(code, self.q)
        near = np.flatnonzero(self.seen[self.slot(hashes)])
        at = np.searchsorted(self.hashes, hashes[near])
        at = np.minimum(at, len(self.hashes) - 1)
        real = self.hashes[at] == hashes[near]
        near, at = near[real], at[real]
        count = self.count[at]
        row = np.repeat(self.first[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(near, count), self.item[row], self.place[row]


    def verbatim(self, code: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(length, number among the items of that length, place) of each short item between word boundaries."""
        outside = np.concatenate(([True], (code == SPACE) | (code == EDGE), [True]))
        for size, (wanted, own) in self.short.items():
            hashes = gram_hashes(code, size)
            # a place begins behind a boundary and ends before one
            near = np.flatnonzero(outside[: len(hashes)] & outside[size + 1 : size + 1 + len(hashes)])
            low = np.searchsorted(wanted, hashes[near], side="left")
            high = np.searchsorted(wanted, hashes[near], side="right")
            for place, first, last in zip(near[low < high], low[low < high], high[low < high]):
                for number in range(first, last):
                    if np.array_equal(code[place : place + size], own[number][1]):
                        yield size, number, int(place)


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole item inside the text, on diagonals low to
    high; None above the budget.  Gaps before and after the item are free."""
    width = high - low + 1
    offset = np.arange(width)
    far = np.int64(1 << 30)
    start = low + offset  # text place of each diagonal at the current row
    cost = np.where((start >= 0) & (start <= len(text)), 0, far)
    # places outside the text equal nothing, so to use one costs as much as to skip the item's character
    before, after = max(-low, 0), max(high + len(item) - len(text), 0)
    padded = np.pad(text, (before, after), constant_values=0xFFFFFFFF)
    for row in range(len(item)):
        at = before + low + row
        along = cost + (padded[at : at + width] != item[row])
        skip = np.append(cost[1:], far) + 1
        less = skip < along
        best = np.where(less, skip, along)
        begin = np.where(less, np.append(start[1:], 0), start)
        # text characters that the item lacks: a running minimum along the row
        ranked = best - offset
        lead = np.maximum.accumulate(np.where(ranked <= np.minimum.accumulate(ranked), offset, 0))
        cost, start = best[lead] + offset - lead, begin[lead]
    end = low + len(item) + offset
    cost = np.where((end >= 0) & (end <= len(text)), cost, far)
    best = int(cost.argmin())
    if cost[best] > budget:
        return None
    return int(cost[best]), int(start[best]), int(end[best])


def exact_place(item: np.ndarray, text: np.ndarray) -> int:
    """First place of the item in the text, -1 if it is not there unchanged."""
    raw, wanted = text.tobytes(), item.tobytes()
    at = raw.find(wanted)
    while at % text.itemsize and at >= 0:
        at = raw.find(wanted, at + 1)
    return at // text.itemsize if at >= 0 else -1


def find(texts: list[str], index: Index) -> list[list[tuple[int | None, int, int, int]]]:
    """For each text (item id, edits, start, end) of the items in it; places are code points."""
    found: list[list[tuple[int | None, int, int, int]]] = [[] for _ in texts]
    if not index.ids and not index.short:
        return found
    code, source, begins = normal(texts)
    first: dict[tuple[int, int, int], int] = {}
    for size, number, place in index.verbatim(code):
        owner = int(np.searchsorted(begins, source[place], side="right") - 1)
        first.setdefault((owner, size, number), place)
    for (owner, size, number), place in sorted(first.items()):
        span = int(source[place] - begins[owner]), int(source[place + size - 1] - begins[owner]) + 1
        found[owner].append((index.short[size][1][number][0], 0, *span))
    if not index.ids:
        return found
    place, item, own = index.shared(code)
    if not len(place):
        return found
    text = np.searchsorted(begins, source[place], side="right") - 1
    # a pair of text and item below the bound on all diagonals together is below it in each band
    pair = text * len(index.ids) + item
    pairs, number, count = np.unique(pair, return_inverse=True, return_counts=True)
    some = (count >= index.bound[pairs % len(index.ids)])[number]
    if not some.any():
        return found
    place, item, own, text = place[some], item[some], own[some], text[some]
    edges = np.concatenate(([-1], np.flatnonzero(code == EDGE)))
    diagonal = place - own - (edges[text] + 1)
    step = index.budget[item] + 1
    # each diagonal lies in two bands, so any k + 1 neighbouring ones lie in one
    band = np.concatenate((diagonal // step, diagonal // step - 1))
    rows = np.stack((np.tile(text, 2), np.tile(item, 2), band, np.tile(own, 2)))
    rows = rows[:, np.lexsort(rows[::-1])]
    fresh = np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))
    rows = rows[:, fresh]
    starts = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))
    counts = np.diff(np.concatenate((starts, [rows.shape[1]])))
    bands = rows[:3, starts]
    likely = bands[:, counts >= index.bound[bands[1]]]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, b in likely.T:
        piece = code[edges[t] + 1 : edges[t + 1]]
        if (t, i) not in best and (place := exact_place(index.codes[i], piece)) >= 0:
            best[t, i] = (0, place, place + len(index.codes[i]))
        if (t, i) in best and not best[t, i][0]:
            continue
        budget, step = int(index.budget[i]), int(index.budget[i]) + 1
        low = int(b) * step
        match = aligned(index.codes[i], piece, low - budget, low + 2 * step - 1 + budget, budget)
        if match and (t, i) not in best or match and match < best[t, i]:
            best[t, i] = match
    for (t, i), (edits, start, end) in sorted(best.items()):
        places = source[edges[t] + 1 : edges[t + 1]] - begins[t]
        found[t].append((index.ids[i], edits, int(places[start]), int(places[end - 1]) + 1))
    return found


MATCHES = "array<struct<item_id:bigint,edits:int,start:int,end:int>>"


def _find_udf(index: Index):
    @F.pandas_udf(MATCHES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for texts in in_batches(batch):
                for matches in find(texts, index):
                    out.append([{"item_id": i, "edits": e, "start": s, "end": z} for i, e, s, z in matches])
            yield pd.Series(out, dtype=object)

    return run


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in lists of bounded size."""
    held, chars = [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        if held and chars + len(row["t"]) > block_chars:
            yield held
            held, chars = [], 0
        held.append((row["i"], row["t"]))
        chars += len(row["t"])
    if held:
        yield held


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add ``matches``: the benchmark items in each text, empty if clean.  A column of that name is replaced."""
    docs = docs.drop("matches")
    parts = []
    for number, items in enumerate(blocks(benchmark, item_id, item_text, block_chars)):
        docs = docs.withColumn(f"__m{number}", _find_udf(Index(items))(F.col(text)))
        parts.append(f"__m{number}")
    matches = F.concat(*parts) if parts else F.array().cast(MATCHES)
    return docs.withColumn("matches", matches).drop(*parts)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
