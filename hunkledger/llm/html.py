"""HTML extraction by nearest-URL page differencing.

Pages of a host that are next to each other by URL path usually come from one template.  The lines
(block texts) that a page shares with its nearest neighbours, by a longest common subsequence, are
template and are deleted, inside what a page marks as its article too, unless the neighbour shares half of
the article (copies of an article are content, not template); elements that are never main text
(menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) are
deleted even where a page has no neighbour.

Pages are dealt by ranges of (host, path, row) whose bounds come from a small hash-picked sample of the
rows, so a host or one URL with a third of all pages is spread over many tasks, and a page finds its
neighbours inside its range.  A neighbour is the next page on either side whose lines differ, past copies and
pages without a line; where it lies in another range, the first and last pages of the ranges are carried over.

html NULL or empty: empty text.  A NULL or odd URL counts as host '' and the path as given.
Repeated rows each get a result.  Truncated markup ends where the text ends.  Extra columns pass
through, but not the html itself, which is moved once and then done with; columns named text or n_chars are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import stage, table

#: Pages a range should hold, and keys sampled to place each bound.
RANGE_PAGES = 2_000
KEYS_PER_BOUND = 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|svg|iframe|object|math|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no main text.
NEVER = frozenset("nav footer header aside form dialog button menu head".split())
#: Whole classes or ids that mean the same; words with other uses are left to page differencing.
BOILERPLATE = frozenset(
    "breadcrumb breadcrumbs cookie cookies masthead nav navbar navigation newsletter popup sidebar signup subscribe".split()
)
#: Those of them whose articles are not the page's own.
OTHERS = frozenset("ad ads advert adverts advertisement advertising comment comments disqus promo promoted related replies sponsored".split())
#: Names of more than one part that mean the same.
COMPOUNDS = frozenset("global-footer global-header main-footer page-footer site-footer site-header site-nav".split())
#: Last parts of a name that only say what kind of box it is: a ``comment-list`` is made of comments.
BOXES = frozenset(
    "area articles banner bar block body bottom box container content feed form inner item items left link links list modal "
    "panel posts right section slot stories thread top unit widget wrap wrapper".split()
)
#: First parts of a name that speak of something else than the element itself: ``has-sidebar``.
STATES = frozenset("has hide is no show with without".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def names(token: str) -> tuple[str, ...]:
    """What a class or id says the element is: the name itself and its last part that is no kind of box.  ``comment-list`` is about
    comments, ``share-price`` about a price, ``has-sidebar`` about something else."""
    parts = re.split("[-_]+", token.strip("-_"))
    if len(parts) == 1 or parts[0] in STATES:
        return (token,)
    while len(parts) > 1 and parts[-1] in BOXES:
        parts.pop()
    return token.replace("_", "-"), parts[-1]


def boilerplate(name: str, attrs: str) -> int:
    """0: may hold main text; 1: not, unless the page's article is inside; 2: nor its articles."""
    if name in MAIN or name in ("html", "body"):
        return 0
    if name in NEVER:
        return 1 if name == "form" else 2
    level = 0
    if "=" in attrs:
        for key, *values in _ATTR.findall(attrs):
            key, words = key.lower(), "".join(values).lower().split()
            if key in ("class", "id"):
                words = [meant for word in words for meant in names(word)]
                level = max(level, 0 if BOILERPLATE.isdisjoint(words) and COMPOUNDS.isdisjoint(words) else 1, 0 if OTHERS.isdisjoint(words) else 2)
            elif key == "role" and not ROLES.isdisjoint(words):
                level = max(level, 1 if "form" in words else 2)
    return level


def lines(html: str) -> list[tuple[str, bool, bool]]:
    """(text, inside the article, inside an element that is never main text) of each block."""
    found: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    open_: list[tuple[str, bool, int]] = []  # name, article from here, boilerplate from here
    inside = skipped = 0

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            found.append((text, inside > 0, skipped > 0))
        held.clear()

    at = 0
    for token in _TOKEN.finditer(html):
        held.append(html[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["end"]:
            places = [i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name][:1]
            if name in BLOCKS:
                close()
            for i in places:
                for _, article, never in open_[i:]:
                    inside -= article
                    skipped -= never > 0
                del open_[i:]
            continue
        if name in BLOCKS:
            close()
        elif name == "br":
            held.append(" ")
        if name in VOID or token["attrs"].endswith("/"):
            continue
        # a block ends an open paragraph, and an item the item before it
        if open_ and (open_[-1][0] == "p" and name in BLOCKS or open_[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd")):
            _, article, never = open_.pop()
            inside -= article
            skipped -= never > 0
        entry = (name, name in MAIN or 'role="main"' in token["attrs"], boilerplate(name, token["attrs"]))
        if entry[1] and skipped and not inside:
            # what holds the page's article or main part is not boilerplate
            freed = 2 if name != "article" else 1
            open_ = [(n, article, 0 if never <= freed else never) for n, article, never in open_]
            skipped = sum(never > 0 for _, _, never in open_)
        open_.append(entry)
        inside += entry[1]
        skipped += entry[2] > 0
    held.append(html[at:])
    close()
    return found


def packed(page: list) -> bytes:
    """A page's lines as they travel to its neighbours: markup gone, deflated."""
    return zlib.compress(json.dumps(page, ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)


def unpacked(page: bytes) -> list[tuple[str, bool, bool]]:
    return [tuple(line) for line in json.loads(zlib.decompress(page).decode("utf-8", "surrogatepass"))]


def unpacked_page(page: bytes) -> tuple[str, list[tuple[str, bool, bool]]]:
    return tuple(json.loads(zlib.decompress(page).decode("utf-8", "surrogatepass")))


def _lines_udf():
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([packed(lines(h) if isinstance(h, str) else []) for h in htmls])

    return run


def shared(own: list[int], other: list[int]) -> set[int]:
    """Positions of ``own`` in a longest common subsequence with ``other``.

    What both begin and end with is in it.  Between, Hunt-Szymanski: the pairs of equal lines, by decreasing place in ``other``
    within each own line, hold a longest increasing run; work is proportional to the number of equal pairs there.
    """
    least = min(len(own), len(other))
    begin = next((i for i in range(least) if own[i] != other[i]), least)
    end = next((i for i in range(least - begin) if own[-1 - i] != other[-1 - i]), least - begin)
    if begin or end:
        inner = shared_between(own[begin : len(own) - end], other[begin : len(other) - end])
        return {*range(begin), *(begin + i for i in inner), *range(len(own) - end, len(own))}
    return shared_between(own, other)


def shared_between(own: list[int], other: list[int]) -> set[int]:
    places: dict[int, list[int]] = {}
    for j, line in enumerate(other):
        places.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(own):
        for j in reversed(places.get(line, ())):
            k = bisect_right(ends, j - 1)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    kept: set[int] = set()
    link = links[-1] if links else None
    while link:
        kept.add(link[0])
        link = link[1]
    return kept


def template_of(own: list[tuple[str, bool, bool]], other: list[tuple[str, bool, bool]]) -> set[int]:
    """Positions of ``own`` that are template by comparison with ``other``.  If at least half of either
    article is shared, one is a copy or a version of the other, and lines inside it are no template."""
    same = shared([text for text, _, _ in own], [text for text, _, _ in other])
    size = lambda page: sum(len(text) for text, inside, never in page if inside and not never)
    inner = {place for place in same if own[place][1]}
    common = sum(len(own[place][0]) for place in inner if not own[place][2])
    if 2 * common >= min(filter(None, (size(own), size(other))), default=0):
        same -= inner
    return same


def main_text(own: list[tuple[str, bool, bool]], template: set[int]) -> str:
    """Join the lines that no neighbour shares, with an article those inside it."""
    article = any(inside and not never for _, inside, never in own)
    kept = [
        text
        for place, (text, inside, never) in enumerate(own)
        if not never and place not in template and (inside or not article)
    ]
    return "\n\n".join(kept)


def nearest(path: str, before: str | None, after: str | None) -> tuple[bool, bool]:
    """Which neighbours are nearest: the one with the longer common beginning of the path, or both."""

    def common(other: str | None) -> int:
        if other is None:
            return -1
        return next((i for i, (a, b) in enumerate(zip(path, other)) if a != b), min(len(path), len(other)))

    a, b = common(before), common(after)
    return a >= 0 and a >= b, b >= 0 and b >= a


def signature(page: bytes) -> bytes | None:
    """The same for pages with the same lines; None without a line."""
    own = unpacked(page)
    return hashlib.md5(json.dumps([text for text, _, _ in own]).encode()).digest() if own else None


def runs_of(hosts: Sequence[str], signs: Sequence[bytes | None]) -> list[list[int]]:
    """Pages in order, in runs of one host and the same lines; pages without a line are left out."""
    runs: list[list[int]] = []
    for i, sign in enumerate(signs):
        if sign is None:
            continue
        if runs and (hosts[runs[-1][0]], signs[runs[-1][0]]) == (hosts[i], sign):
            runs[-1].append(i)
        else:
            runs.append([i])
    return runs


def differenced(path: str, own: list, sides: list, templates: dict[int, set[int]], texts: dict[tuple[bool, bool], str]) -> str:
    """Text of a page by its (path, lines) on either side; what is found for its copies is held."""
    near = nearest(path, *(side and side[0] for side in sides))
    if near not in texts:
        for n, (side, wanted) in enumerate(zip(sides, near)):
            if wanted and n not in templates:
                templates[n] = template_of(own, side[1])
        texts[near] = main_text(own, set().union(*(templates[n] for n in (0, 1) if near[n])))
    return texts[near]


def carries(ends: list[tuple[int, str, str, bytes]]) -> list[tuple[int, int, int, str]]:
    """(range, side, range and role of the page that its first (side 0) or last (1) pages need), from the
    (range, role, host, signature) of the pages at the ends of each range."""
    found = {(number, role): (host, bytes(sign)) for number, role, host, sign in ends}
    numbers = sorted({number for number, *_ in ends})
    out = []
    for side, mine, yours, way in ((0, "first0", ("last1", "last0"), numbers), (1, "last0", ("first1", "first0"), numbers[::-1])):
        past: list[tuple[int, str]] = []  # the last unlike pages, latest at the end
        for number in way:
            host, sign = found[number, mine]
            fit = next((end for end in reversed(past) if found[end] != (host, sign)), None)
            if fit and found[fit][0] == host:
                out.append((number, side, *fit))
            for role in yours:
                if (number, role) in found:
                    if past and found[past[-1]] == found[number, role]:
                        past.pop()
                    past = [*past[-1:], (number, role)]
    return out


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), F.lit(""))


def spread(pages: DataFrame, key: Column, html: str) -> Column:
    """A key, then the row's content and place, so that rows of one key have an order of their own."""
    told = [c for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.hex(F.xxhash64(F.xxhash64(html), F.xxhash64(*told)))
    return F.concat_ws("\u0001", key, F.lpad(row, 16, "0"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))


def bounds(keyed: DataFrame, range_pages: int) -> list[str]:
    """Places that cut the pages into ranges of about ``range_pages``: every KEYS_PER_BOUND-th of the places that a
    hash picks, put in order and numbered by Spark; the driver gets the bounds only."""
    every = max(1, range_pages // KEYS_PER_BOUND)
    step = range_pages // every
    picked = keyed.filter(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).select("place").orderBy("place")
    return picked.rdd.zipWithIndex().filter(lambda r: r[1] % step == step - 1).map(lambda r: r[0][0]).collect()


def extract(pages: DataFrame, url: str = "url", html: str = "html", range_pages: int = RANGE_PAGES) -> DataFrame:
    """Add text and n_chars (code points) of the main text of each page."""
    key = F.concat(host(F.col(url)), F.lit("\u0001"), path(F.col(url)))
    pages = pages.drop(*({"text", "n_chars"} - {html, url}))
    keyed = pages.withColumn("__key", key).withColumn("__place", spread(pages, key, html))
    cuts = bounds(keyed.select(F.col("__place").alias("place")), range_pages)
    placed = keyed.withColumn("__range", F.size(F.filter(F.lit(cuts).cast("array<string>"), lambda c: c <= F.col("__place"))))
    schema = pages.schema

    kept = [f for f in schema.fieldNames() if f not in ("text", "n_chars", html)]
    fields = [StructField(f.name, f.dataType, True) for f in schema.fields if f.name in kept]
    result = StructType(fields).add("text", "string").add("n_chars", "long")
    dealt = StructType(list(result.fields)).add("__range", "integer").add("__role", "string").add("__host", "string").add("__sign", "binary").add("__pack", "binary")
    n_ranges = len(cuts) + 1

    def difference(group: pa.Table) -> pa.Table:
        keys, packs, at = group["__key"].to_pylist(), group["__lines"].to_pylist(), group["__place"].to_pylist()
        number = group["__range"][0].as_py()
        order = sorted(range(len(keys)), key=at.__getitem__)
        signs, last = [], (None, None)
        for i in order:
            if packs[i] != last[0]:
                last = packs[i], signature(packs[i])
            signs.append(last[1])
        hosts, paths = zip(*(keys[i].split("\u0001", 1) for i in order))
        runs = runs_of(hosts, signs)
        page_at = lambda i: [paths[i], unpacked(packs[order[i]])]
        out: list[tuple] = [(i, "", 0, "done", None, None, None) for i, sign in enumerate(signs) if sign is None]
        for k, run in enumerate(runs):
            sides: list = []
            for other, edge, place in ((k - 1, number == 0, -1), (k + 1, number == n_ranges - 1, 0)):
                if 0 <= other < len(runs):
                    sides.append(page_at(runs[other][place]) if hosts[runs[other][place]] == hosts[run[0]] else None)
                else:
                    sides.append(None if edge else "open")
            own = unpacked(packs[order[run[0]]])
            texts: dict[tuple[bool, bool], str] = {}
            templates: dict[int, set[int]] = {}
            for i in run:
                if "open" in sides:
                    out.append((i, None, None, "open", hosts[i], None, packed([paths[i], own, *sides])))
                else:
                    text = differenced(paths[i], own, sides, templates, texts)
                    out.append((i, text, len(text), "done", None, None, None))
        # what neighbouring ranges may need of this one
        for role, k, place in (("first0", 0, 0), ("first1", 1, 0), ("last0", -1, -1), ("last1", -2, -1)) if n_ranges > 1 else ():
            if -len(runs) <= k < len(runs):
                i = runs[k][place]
                out.append((None, None, None, role, hosts[i], signs[i], packed(page_at(i))))
        rows = pa.array([None if o[0] is None else order[o[0]] for o in out], pa.int64())
        _, text, n_chars, role, host_, sign, pack = zip(*out) if out else [()] * 7
        found = group.drop_columns(["__key", "__place", "__range", "__lines"]).take(rows)
        for name, values, kind in (("text", text, pa.string()), ("n_chars", n_chars, pa.int64()), ("__range", [number] * len(out), pa.int32()), ("__role", role, pa.string()), ("__host", host_, pa.string()), ("__sign", sign, pa.binary()), ("__pack", pack, pa.binary())):
            found = found.append_column(name, pa.array(values, kind))
        return found

    def finish(group: pa.Table, carried: pa.Table) -> pa.Table:
        over = {side: unpacked_page(pack) for side, pack in zip(carried["side"].to_pylist(), carried["pack"].to_pylist())}
        texts = []
        for pack in group["__pack"].to_pylist():
            path_, own, *sides = json.loads(zlib.decompress(pack).decode("utf-8", "surrogatepass"))
            sides = [over.get(n) if side == "open" else side for n, side in enumerate(sides)]
            texts.append(differenced(path_, own, sides, {}, {}))
        out = group.select(kept)
        return out.append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array(map(len, texts), pa.int64()))

    told = (
        placed.select(*kept, "__key", "__place", "__range", _lines_udf()(F.col(html)).alias("__lines"))
        .groupBy("__range").applyInArrow(difference, dealt)
    )
    if not cuts:
        return told.select(result.fieldNames())
    # zstd: the texts lie there until the few open pages have met what is carried to them
    told = stage(told, "main-text", compression="zstd")
    opened_as = told.select(result.fieldNames()).schema  # what is read back may hold NULLs
    ends = told.filter(~F.col("__role").isin("done", "open"))
    carry = carries([tuple(r) for r in ends.select("__range", "__role", "__host", "__sign").collect()])
    spark = pages.sparkSession
    carry = spark.createDataFrame(carry, "to int, side int, __range int, __role string")
    carried = ends.select("__range", "__role", "__pack").join(carry, ["__range", "__role"]).select(F.col("to").alias("__range"), "side", F.col("__pack").alias("pack"))
    opened = told.filter("__role = 'open'").select(*kept, "__range", "__pack")
    closed = opened.groupBy("__range").cogroup(carried.groupBy("__range")).applyInArrow(finish, opened_as)
    return told.filter("__role = 'done'").select(result.fieldNames()).unionByName(closed)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
