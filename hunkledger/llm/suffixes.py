"""Suffix-array dedup: a depth-limited radix sort of suffixes.

A byte goes if a string of ``threshold`` bytes that covers it also starts in a document with a smaller
id.  Only order up to that depth matters, so suffixes are sorted by most-significant-digit passes
that stop there, and a suffix alone in its group leaves the sort.  The first passes are Spark's:

1. Each window of ``threshold`` bytes is dealt by one digit, the hash of its anchor: the leftmost of its
   ``GRAM``-byte strings with the least hash.  Equal windows have equal anchors at equal places, and
   neighbouring windows mostly share theirs, so one number stands for some twenty suffixes.  Anchors
   seen in one document only are done.
2. For each anchor left, the bytes of its windows (one piece of text) are dealt by the same
   digit.  The other digits, eight bytes at a time, are sorted inside the task: first whole pieces, of
   which equal ones go on as one with their smallest document, then the windows of unequal pieces
   with the same anchor.  Equal groups at full depth are exactly the repeated windows.

Documents are dealt into batches by a hash, and every step gets and returns one packed row for each batch
and digit group.  Equal pieces of a batch travel as one with their smallest document; the others of them
are settled in the batch, so a passage that a third of all documents hold is one entry a batch.  An anchor
with more than ``SPLIT`` unlike pieces (a frequent string in unlike contexts) is no digit group of its own:
its windows are dealt one by one, by the hash of all their bytes.

Texts are UTF-8 bytes; NULL counts as empty.  Rows without doc_id neither remove nor lose bytes.  Rows
that share a doc_id do not remove each other's bytes.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 50
#: Length of an anchor.
GRAM = 16
#: Bytes of text a batch and a digit group should hold.
BATCH_BYTES = 2_000_000
GROUP_BYTES = 8_000_000
#: Unlike pieces an anchor may have before its windows are dealt one by one.
SPLIT = 20_000
#: Bytes hashed together, and rows of bytes compared together.
HASHED = 1 << 20
COMPARED = 20_000
#: Bytes whose anchors are found together; windows that reach over the edge belong to the first piece.
PIECE = 8_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_PLACE_BITS = np.uint64(24)
with np.errstate(over="ignore"):
    _BYTES = np.arange(1, 257, dtype=np.uint64) * _SPREAD
    _BYTES = (_BYTES ^ (_BYTES >> np.uint64(32))) * np.uint64(_BASE)


@lru_cache(1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def span_hashes(raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of at most 255 bytes, from differences of running sums."""
    out = np.zeros(len(at), dtype=np.uint64)
    power, inverse = powers(HASHED + 256)
    for begin in range(0, len(raw), HASHED):
        own = np.flatnonzero((at >= begin) & (at < begin + HASHED))
        if len(own):
            part = raw[begin : begin + HASHED + 255]
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[part] * power[: len(part)], dtype=np.uint64)))
            a = at[own] - begin
            out[own] = (total[a + length[own]] - total[a]) * inverse[a]
    out ^= out >> np.uint64(32)
    out *= _SPREAD
    return out ^ (out >> np.uint64(29))


def first_equals(raw: np.ndarray, at: np.ndarray, length: np.ndarray, tag: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each span the number of the first one with equal bytes and tag."""
    order = np.lexsort((at, hashes))
    same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1]))[: len(order)]
    maybe = np.flatnonzero(same)
    for begin in range(0, len(maybe), COMPARED):
        some = maybe[begin : begin + COMPARED]
        a, b = order[some], order[some - 1]
        places = np.arange(length[a].max())
        inside = places[None, :] < length[a][:, None]
        unlike = raw[np.minimum(at[a][:, None] + places, len(raw) - 1)] != raw[np.minimum(at[b][:, None] + places, len(raw) - 1)]
        same[some] = (length[a] == length[b]) & (tag[a] == tag[b]) & ~(unlike & inside).any(axis=1)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    return out


def merged(raw: np.ndarray, base: np.ndarray, ids: np.ndarray, number: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, anchor: np.ndarray, hot: np.ndarray, threshold: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The unlike pieces of a batch, and what is settled about their equals.

    Texts lie in ``raw`` from ``base`` on, by ascending id.  Pieces (text number, first window, windows,
    place of the anchor in the piece, digit) come first, each of the smallest document that holds it; the windows of
    hot pieces are pieces of their own.  Then runs (text, begin, end) that a smaller document of the batch
    holds, and copies (text, first window, windows, text and first window of the copy) within a document, which
    fare as the piece does.
    """
    before, digit = place - first, anchor
    if hot.any():
        n = count[hot]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        apart = (np.repeat(number[hot], n), np.repeat(first[hot], n) + offset, np.ones_like(offset), np.zeros_like(offset))
        number, first, count, before = (np.concatenate((x[~hot], y)) for x, y in zip((number, first, count, before), apart))
        digit = np.concatenate((anchor[~hot], np.zeros(len(offset), dtype=np.uint64)))
    at, length, tag = base[number] + first, count + threshold - 1, before * 256 + count
    hashes = span_hashes(raw, at, length)
    if hot.any():
        digit[len(digit) - len(offset) :] = hashes[len(digit) - len(offset) :] >> _PLACE_BITS
    lead = first_equals(raw, at, length, tag, hashes ^ (tag.astype(np.uint64) * _SPREAD))
    own = lead == np.arange(len(lead))
    larger = ids[number] > ids[number[lead]]
    order = np.flatnonzero(larger)[np.argsort(at[larger], kind="stable")]
    no, begin, stop = number[order], first[order], (first + count)[order]
    new = np.concatenate(([True], (no[1:] != no[:-1]) | (begin[1:] != stop[:-1])))[: len(no)]
    ends = stop[np.concatenate((new[1:], [True]))[: len(no)]] + threshold - 1
    runs = np.stack((no[new], begin[new], ends), axis=1).astype("<i4")
    rest = ~own & ~larger
    copies = np.stack((number[lead[rest]], first[lead[rest]], count[rest], number[rest], first[rest]), axis=1).astype("<i4")
    return tuple(x[own] for x in (number, first, count, before, digit)), runs, copies


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """40-bit hash of every string of ``size`` bytes, built by doubling."""
    with np.errstate(over="ignore"):
        out, power, length = raw.astype(np.uint64), np.uint64(_BASE), 1
        while length * 2 <= size:
            out = out[:-length] * power + out[length:]
            power, length = power * power, length * 2
        if length != size:
            raise ValueError("the anchor length must be a power of two")
        out ^= out >> np.uint64(32)
        out *= _SPREAD
    return out >> _PLACE_BITS


def pieces(raw: np.ndarray, threshold: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, windows, anchor place, anchor hash) of each stretch of windows with one anchor.

    The windows of each PIECE start in it; their last bytes may lie after it.
    """
    width = threshold - gram + 1
    for begin in range(0, max(len(raw) - threshold + 1, 0), PIECE):
        part = raw[begin : begin + PIECE + threshold - 1]
        key = (gram_hashes(part, gram) << _PLACE_BITS) | np.arange(len(part) - gram + 1, dtype=np.uint64)
        length = 1
        while length * 2 <= width:
            key = np.minimum(key[:-length], key[length:])
            length *= 2
        if width > length:
            key = np.minimum(key[: len(key) - (width - length)], key[width - length :])
        change = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        first = key[change]
        place = (first & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        yield change + begin, np.diff(np.append(change, len(key))), place + begin, first >> _PLACE_BITS


def stretches(texts: list[bytes], wanted: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor place, anchor hash) of all wanted texts; places count
    from the start of the text."""
    out: list[tuple[np.ndarray, ...]] = []
    held: list[int] = []

    def close() -> None:
        raw = np.frombuffer(b"".join(texts[i] for i in held), dtype=np.uint8)
        ends = np.cumsum([len(texts[i]) for i in held])
        starts = np.concatenate(([0], ends[:-1]))
        for first, count, place, anchor in pieces(raw, threshold, gram):
            # cut stretches at the ends of texts, and leave out windows that reach into the next text
            for edge in (0, 1):
                owner = np.searchsorted(ends, first, side="right")
                last = first + count - 1
                limit = ends[owner] - threshold
                own = np.minimum(last, limit) - first + 1
                some = own > 0
                out.append((np.array(held)[owner[some]], (first - starts[owner])[some], own[some], (place - starts[owner])[some], anchor[some]))
                # the rest of a stretch that goes on in a later text
                over = last >= ends[owner]
                if not over.any():
                    break
                first, count, place, anchor = ends[owner[over]], (last - ends[owner] + 1)[over], place[over], anchor[over]
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        if wanted[i] and len(text) >= threshold:
            held.append(i)
            size += len(text)
            if size >= BATCH_BYTES:
                close()
                size = 0
    if held:
        close()
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def anchors(text: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a batch, ascending, and whether several of its texts hold each."""
    order = np.lexsort((text, anchor))
    anchor, text = anchor[order], text[order]
    new = np.concatenate(([True], anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, dtype=bool)
    other = np.concatenate(([False], (anchor[1:] == anchor[:-1]) & (text[1:] != text[:-1]))) if len(anchor) else new
    starts = np.flatnonzero(new)
    return anchor[new], np.add.reduceat(other, starts) > 0 if len(starts) else other


def equal_groups(rows: np.ndarray) -> np.ndarray:
    """A group number for each row of bytes, the same for equal rows only: most-significant-digit passes of
    eight bytes, each over the rows that are not yet alone."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = rows
    digits = padded.view(">u8").astype(np.uint64)
    group = np.zeros(n, dtype=np.int64)
    alive, issued = np.arange(n), 1
    for column in range(digits.shape[1]):
        if not len(alive):
            break
        digit, own = digits[alive, column], group[alive]
        order = np.lexsort((digit, own))
        alive, digit, own = alive[order], digit[order], own[order]
        new = np.concatenate(([True], (digit[1:] != digit[:-1]) | (own[1:] != own[:-1])))
        number = np.cumsum(new) - 1
        group[alive] = number + issued
        issued += int(number[-1]) + 1
        alive = alive[np.bincount(number)[number] > 1]
    return np.unique(group, return_inverse=True)[1] if n else group


def repeated(pieces_: np.ndarray, before: np.ndarray, windows: np.ndarray, docs: np.ndarray, threshold: int, gram: int) -> np.ndarray:
    """For each piece and window, whether the window also starts in a smaller document.

    ``pieces_``: n x bytes, zero-padded; ``before``: anchor place in the piece; ``windows``: windows of
    the piece; ``docs``: its document.  The result is flat, ``windows`` entries a piece.
    """
    n = len(pieces_)
    tagged = np.concatenate((before[:, None].astype(np.uint8), windows[:, None].astype(np.uint8), pieces_), axis=1)
    same = equal_groups(tagged)
    least = np.full(int(same.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, docs)
    _, example = np.unique(same, return_index=True)
    # windows of unequal pieces that share an anchor
    anchor = pieces_[example[:, None], before[example][:, None] + np.arange(gram)] if n else pieces_[:, :gram]
    anchor_group = equal_groups(anchor)
    several = np.bincount(anchor_group, minlength=1)[anchor_group] > 1 if n else np.zeros(0, dtype=bool)
    count = windows[example]
    starts = np.concatenate(([0], np.cumsum(count)))
    lowest = np.repeat(least, count)
    order = np.flatnonzero(several)[np.argsort(anchor_group[several], kind="stable")]
    for chunk in at_borders(anchor_group[order], 10_000):
        own = order[chunk]
        total = count[own]
        # equal windows have their anchor at equal places, so many pieces go place by place
        for place in [None] if len(own) <= 20_000 else range(threshold - gram + 1):
            if place is None:
                row = np.repeat(own, total)
                offset = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            else:
                offset = before[example[own]] - place
                inside = (offset >= 0) & (offset < total)
                row, offset = own[inside], offset[inside]
            window = pieces_[example[row][:, None], offset[:, None] + np.arange(threshold)]
            equal = equal_groups(window)
            best = np.full(int(equal.max(initial=-1)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, equal, least[row])
            lowest[starts[row] + offset] = best[equal]
    total = windows
    offset = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return np.repeat(docs, total) > lowest[np.repeat(starts[same], total) + offset]


def at_borders(groups: np.ndarray, size: int) -> Iterator[slice]:
    """Slices of about ``size`` rows that end where a group ends."""
    begin = 0
    while begin < len(groups):
        end = min(begin + size, len(groups))
        while end < len(groups) and groups[end] == groups[end - 1]:
            end += 1
        yield slice(begin, end)
        begin = end


def ordered(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int | None]]:
    """Ids (0 where NULL), which are not NULL, bytes and original ids of a batch, always in the same order."""
    ids, texts = batch["doc_id"].to_pylist(), [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    return np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is not None for i in ids]), texts, ids


def rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()})


def removed_runs(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes some interval covers."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another, and where each begins."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(size) - size


def copied(run: np.ndarray, copies: np.ndarray, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """The runs of copies: those of the windows of the pieces they equal."""
    if not len(run) or not len(copies):
        return np.zeros((0, 3), dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    gone = removed_runs(int(sizes.sum()), base[run[:, 0]] + run[:, 1], base[run[:, 0]] + run[:, 2] - threshold + 1)
    out = []
    for begin in range(0, len(copies), COMPARED):
        no, first, n, copy, to = copies[begin : begin + COMPARED].T
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = gone[np.repeat(base[no] + first, n) + offset]
        start = (np.repeat(to, n) + offset)[hit]
        out.append(np.stack((np.repeat(copy, n)[hit], start, start + threshold), axis=1))
    return np.concatenate(out)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, group_bytes: int = GROUP_BYTES, with_kept: bool = True, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, the kept bytes, for each row."""
    if threshold < gram or threshold - gram + threshold > 255:
        raise ValueError("the threshold must lie between the anchor length and 135")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_groups = total // batch_bytes + 1, total // group_bytes + 1
    batch = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_batches)).cast("long")
    batches = docs.withColumn("batch", batch)
    most = 2 * threshold - gram  # bytes of the longest piece

    def grouped(hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(n_groups)).astype(np.int64)

    def deal_anchors(part: pa.Table) -> pa.Table:
        _, known, texts, _ = ordered(part)
        number, first, count, place, anchor = stretches(texts, known, threshold, gram)
        hashes, several = anchors(number, anchor)
        raw, base = joined(texts)
        contents = span_hashes(raw, base[number] + first, count + threshold - 1)
        by = np.lexsort((contents, anchor))
        unlike = np.concatenate(([True], (contents[by][1:] != contents[by][:-1]) | (anchor[by][1:] != anchor[by][:-1])))[: len(by)]
        n_unlike = np.bincount(np.searchsorted(hashes, anchor[by][unlike]), minlength=len(hashes))
        group = grouped(hashes)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0))) if len(order) else order
        packed = []
        for o in np.split(order, cuts[1:]):
            if len(o):
                # place and unlike pieces of the anchors with more than one
                more = np.flatnonzero(n_unlike[o] > 1)
                counts = np.stack((more, n_unlike[o][more]), axis=1).astype("<u4")
                packed.append((int(group[o[0]]), (hashes[o] // np.uint64(n_groups)).astype("<u4").tobytes(), np.packbits(several[o]).tobytes(), counts.tobytes()))
        one = part["batch"][0].as_py()
        g, v, s, c = zip(*packed) if packed else ((), (), (), ())
        return rows({"group": (list(g), pa.int64()), "batch": ([one] * len(g), pa.int64()), "vals": (list(v), pa.binary()), "several": (list(s), pa.binary()), "counts": (list(c), pa.binary())})

    def meet_anchors(group: pa.Table) -> pa.Table:
        values = [np.frombuffer(v, dtype="<u4") for v in group["vals"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(s, dtype=np.uint8), count=len(v)) for s, v in zip(group["several"].to_pylist(), values)]
        flat = np.concatenate(values)
        order = np.argsort(flat, kind="stable")
        same = np.concatenate(([False], flat[order][1:] == flat[order][:-1]))
        more = np.zeros(len(flat), dtype=np.uint8)
        more[order] = same | np.append(same[1:], False)
        more |= np.concatenate(several)
        number = np.ones(len(flat), dtype=np.int64)
        begins = np.cumsum([0] + [len(v) for v in values])
        for begin, c in zip(begins, group["counts"].to_pylist()):
            at, n = np.frombuffer(c, dtype="<u4").reshape(-1, 2).astype(np.int64).T
            number[begin + at] = n
        which = np.cumsum(~same) - 1
        hot = np.zeros(len(flat), dtype=np.uint8)
        hot[order] = (np.bincount(which, weights=number[order]) > split)[which] if len(flat) else 0
        marks = [np.packbits(m).tobytes() for m in np.split(more, begins[1:-1])]
        hots = [np.packbits(h).tobytes() if h.any() else b"" for h in np.split(hot, begins[1:-1])]
        return rows({"batch": (group["batch"].to_pylist(), pa.int64()), "group": (group["group"].to_pylist(), pa.int64()), "marks": (marks, pa.binary()), "hot": (hots, pa.binary())})

    def deal_pieces(part: pa.Table, marks: pa.Table) -> pa.Table:
        empty = rows({"group": ([], pa.int64()), "batch": ([], pa.int64()), "docs": ([], pa.binary()), "heads": ([], pa.binary()), "bytes": ([], pa.binary())})
        if not part.num_rows or not marks.num_rows:
            return empty
        ids, known, texts, _ = ordered(part)
        number, first, count, place, anchor = stretches(texts, known, threshold, gram)
        hashes, _ = anchors(number, anchor)
        group = grouped(hashes)
        open_ = np.zeros(len(hashes), dtype=bool)
        hot = np.zeros(len(hashes), dtype=bool)
        # anchors by group, each group in its own order, found by binary search
        by_group = np.argsort(group, kind="stable")
        told = np.array(marks["group"].to_pylist(), dtype=np.int64)
        lows = np.searchsorted(group[by_group], told, side="left")
        highs = np.searchsorted(group[by_group], told, side="right")
        for low, high, m, h in zip(lows, highs, marks["marks"].to_pylist(), marks["hot"].to_pylist()):
            own = by_group[low:high]
            open_[own] = np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(own)).astype(bool)
            if h:
                hot[own] = np.unpackbits(np.frombuffer(h, dtype=np.uint8), count=len(own)).astype(bool)
        which = np.searchsorted(hashes, anchor)
        some = open_[which] if len(hashes) else np.zeros(0, dtype=bool)
        number, first, count, place, anchor, which = (x[some] for x in (number, first, count, place, anchor, which))
        if not len(number):
            return empty
        raw, base = joined(texts)
        (number, first, count, before, digit), settled, copies = merged(raw, base, ids, number, first, count, place, anchor, hot[which], threshold)
        owner = grouped(digit)
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(owner[order]) != 0)))
        out = []
        for o in np.split(order, cuts[1:]):
            # document number and first window of each piece, then place of the anchor and number of windows
            head = np.zeros(len(o), dtype=[("no", "<i4"), ("first", "<i4"), ("before", "u1"), ("windows", "u1")])
            head["no"], head["first"], head["before"], head["windows"] = number[o], first[o], before[o], count[o]
            raw = b"".join(texts[n][a : a + c + threshold - 1] for n, a, c in zip(number[o], first[o], count[o]))
            out.append((int(owner[o[0]]), ids[number[o]].astype("<i8").tobytes(), head.tobytes(), raw))
        # what the batch has settled itself passes by in a group of its own
        one = part["batch"][0].as_py()
        if len(settled) or len(copies):
            out.append((-1 - one, b"", copies.tobytes(), settled.tobytes()))
        g, d, h, r = zip(*out)
        return rows({"group": (list(g), pa.int64()), "batch": ([one] * len(g), pa.int64()), "docs": (list(d), pa.binary()), "heads": (list(h), pa.binary()), "bytes": (list(r), pa.binary())})

    def meet_pieces(group: pa.Table) -> pa.Table:
        if group["group"][0].as_py() < 0:
            return rows({"batch": (group["batch"].to_pylist(), pa.int64()), "runs": (group["bytes"].to_pylist(), pa.binary()), "copies": (group["heads"].to_pylist(), pa.binary())})
        kind = [("no", "<i4"), ("first", "<i4"), ("before", "u1"), ("windows", "u1")]
        heads = [np.frombuffer(h, dtype=kind) for h in group["heads"].to_pylist()]
        head = np.concatenate(heads)
        ids = np.concatenate([np.frombuffer(d, dtype="<i8") for d in group["docs"].to_pylist()])
        raw = np.frombuffer(b"".join(group["bytes"].to_pylist()), dtype=np.uint8)
        length = head["windows"].astype(np.int64) + threshold - 1
        starts = np.cumsum(length) - length
        matrix = np.zeros((len(head), most), dtype=np.uint8)
        filled = np.arange(most)[None, :] < length[:, None]
        matrix[filled] = raw
        windows = head["windows"].astype(np.int64)
        gone = repeated(matrix, head["before"].astype(np.int64), windows, ids, threshold, gram)
        # runs of removed windows within a piece
        piece = np.repeat(np.arange(len(head)), windows)
        offset = np.arange(len(gone)) - np.repeat(np.cumsum(windows) - windows, windows)
        begins = gone & ~np.concatenate(([False], gone[:-1] & (piece[1:] == piece[:-1])))
        stops = gone & ~np.concatenate((gone[1:] & (piece[1:] == piece[:-1]), [False]))
        owner = piece[begins]
        runs = np.stack((head["no"][owner], head["first"][owner] + offset[begins], head["first"][owner] + offset[stops] + threshold), axis=1).astype("<i4")
        # runs lie in the order of their pieces, and so of the batches
        ends = np.searchsorted(owner, np.cumsum([len(h) for h in heads]), side="left")
        packed = [r.tobytes() for r in np.split(runs, ends[:-1])]
        return rows({"batch": (group["batch"].to_pylist(), pa.int64()), "runs": (packed, pa.binary()), "copies": ([b""] * len(packed), pa.binary())})

    def cut_out(part: pa.Table, runs: pa.Table) -> pa.Table:
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        out: list[tuple] = []
        if part.num_rows:
            _, _, texts, ids = ordered(part)
            run = np.concatenate([np.frombuffer(r, dtype="<i4") for r in runs["runs"].to_pylist()] or [np.zeros(0, "<i4")]).reshape(-1, 3).astype(np.int64)
            copies = np.concatenate([np.frombuffer(c, dtype="<i4") for c in runs["copies"].to_pylist()] or [np.zeros(0, "<i4")]).reshape(-1, 5).astype(np.int64)
            run = np.concatenate((run, copied(run, copies, np.array([len(t) for t in texts]), threshold)))
            run = run[np.argsort(run[:, 0], kind="stable")]
            cuts = np.searchsorted(run[:, 0], np.arange(len(texts) + 1))
            for i, raw in enumerate(texts):
                own = run[cuts[i] : cuts[i + 1]]
                if len(own):
                    gone = removed_runs(len(raw), own[:, 1], own[:, 2])
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                else:
                    kept, spans = raw, 0
                out.append((ids[i], len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        return rows({name: (list(values), kind) for name, kind, values in zip(names, kinds, zip(*out) if out else [[]] * 6)})

    dealt = batches.groupBy("batch").applyInArrow(deal_anchors, "group long, batch long, vals binary, several binary, counts binary")
    marks = dealt.groupBy("group").applyInArrow(meet_anchors, "batch long, group long, marks binary, hot binary")
    pieced = batches.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(deal_pieces, "group long, batch long, docs binary, heads binary, bytes binary")
    runs = pieced.groupBy("group").applyInArrow(meet_pieces, "batch long, runs binary, copies binary")
    result = batches.groupBy("batch").cogroup(runs.groupBy("batch")).applyInArrow(
        cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return result if with_kept else result.drop("kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), with_kept=False)


#: The same by plain 50-byte windows.  Texts are cut into overlapping pieces of 1,000 bytes first, since a
#: window cut from a whole text costs its length.
ORACLE = """
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
    SELECT *, length(h) // 2 AS n FROM texts
), pieces AS (
    SELECT r, doc_id, n, 1000 * k AS base, substr(h, 2000 * k + 1, 2098) AS piece
    FROM (SELECT *, unnest(range(0, (n + 950) // 1000)) AS k FROM sized WHERE n >= 50)
), windows AS (
    SELECT r, doc_id, base + i AS start, substr(piece, 2 * i + 1, 100) AS w
    FROM (SELECT *, unnest(range(0, least(1000, n - 49 - base))) AS i FROM pieces)
), firsts AS (
    SELECT w, min(doc_id) AS least_id FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), hits AS (
    SELECT r, start, lag(start) OVER (PARTITION BY r ORDER BY start) AS prev
    FROM windows JOIN firsts USING (w) WHERE doc_id > least_id
), marked AS (
    SELECT r, start, sum(CASE WHEN prev IS NULL OR start > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY start) AS run
    FROM hits
), runs AS (
    SELECT r, run, min(start) AS a, max(start) + 50 AS z FROM marked GROUP BY r, run
), gaps AS (
    SELECT r, run, z - a AS gone, coalesce(lag(z) OVER (PARTITION BY r ORDER BY run), 0) AS kept_from, a AS kept_to, z FROM runs
), cut AS (
    SELECT r, sum(gone) AS n_removed, count(*) AS n_spans, max(z) AS last,
           string_agg(substr(h, 2 * kept_from + 1, 2 * (kept_to - kept_from)), '' ORDER BY run) AS head
    FROM gaps JOIN sized USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM sized LEFT JOIN cut USING (r)
"""
