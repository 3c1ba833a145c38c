"""Merkle dataset manifest with a recursive climb.

Every row is a leaf; the leaves of a source, in order of their ids, are hashed in runs of ``FANOUT`` into a subroot,
and the subroots, in order of their sources, into the root.  The built levels are stored as node rows, each with its
parent and the siblings on its left and right.  A recursive query (``WITH RECURSIVE``) then ascends: every leaf's hash, tampered or
not, is folded with the siblings of its node, which are appended to the proof, until it arrives at the root.

* The leaves of one run share everything above the run, so a row of the climb is a run, whose at most ``FANOUT`` leaves are
  folded each for itself, and whose proof is held once.
* Places within a source come from one sort by ranges of (source, id, hash) and from counts by range, never from a window over a
  source, so a source may hold any share of the rows, and so may rows without an id.
* All rows of a source pass its upper nodes.  A node that more than ``RUNS_A_COPY`` runs pass is stored in several copies; each run
  takes one of them by its hash, so no join has a hot key.
* Digests travel as 32 bytes and are hashed as lower-case hex text.  Levels, runs and the result of the climb are tables in the shared folder;
  the driver reads counts and the root only.

Defined results: a NULL field is hashed as ``-``.  Rows without an id come first in their source and are never tampered with;
NULL is a source of its own, before the others.  Rows of one id are ordered by their hash; rows that repeat entirely
are leaves of their own with equal results or, in places of their own, unlike proofs.  Empty texts are ``0:``.  An empty table gives no
rows and has no root.  Other columns than the hashed ones take no part.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, stage, table

FANOUT = 16
#: Runs that take one copy of a node.
RUNS_A_COPY = 4_096
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
#: Rows a recursive query may make in all, by Spark's setting; the climb's grow with the table.
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def written(value: Column) -> Column:
    """A field as a leaf hashes it: its length in bytes, a colon and the value; ``-`` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(digests: Column) -> Column:
    """The digest of digests that lie one after another, taken as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda held, digest: F.concat(held, digest))


def name(tree: Column, level: Column, place: Column) -> Column:
    return F.concat_ws(".", tree, level.cast("string"), place.cast("string"))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, leaf and, for the rows tampered with, the leaf with A-Z of the text lower-cased."""
    own = lambda changed: F.unhex(F.sha2(F.concat(*(written(changed if f == text and changed is not None else F.col(f)) for f in fields)), 256))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), own(None).alias("leaf"),
        F.when(fold(F.col(doc_id).cast("long")) == 0, own(F.translate(text, UPPER, LOWER))).alias("tampered"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """Add each leaf's place in its source, the source's number and how many leaves it has."""
    order = ["source", "doc_id", "leaf", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    seq = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("seq", F.monotonically_increasing_id())
    # the high bits of seq are the range, the low ones the place in it
    kept = stage(seq, "merkle-leaves").withColumn("part", F.shiftright("seq", 33))
    groups = kept.groupBy("part", "source").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("source")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(own))
    # sources begin in the order of the ranges; a window over all ranges holds one row for each
    begins = groups.filter("before = 0").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("source")))
    earlier = begins.groupBy("part").agg(F.count("*").alias("begun"))
    earlier = earlier.withColumn("past", F.sum("begun").over(Window.orderBy("part")) - F.col("begun"))
    numbers = begins.join(earlier, "part").select("source", (F.col("past") + F.col("nth") - 1).alias("number"))
    groups, numbers = groups.alias("g"), numbers.alias("n")
    groups = groups.join(numbers, F.col("g.source").eqNullSafe(F.col("n.source"))).select("g.part", "g.source", "first", "before", "total", "number")
    same = (F.col("k.part") == F.col("g.part")) & F.col("k.source").eqNullSafe(F.col("g.source"))
    return kept.alias("k").join(groups.alias("g"), same).select(
        "doc_id", "leaf", "tampered", "number", "total", (F.col("before") + F.col("seq") - F.col("first")).alias("place")
    )


@dataclass
class Manifest:
    """runs: leaves in runs, by (number of the source, run).  nodes: node rows linked to their parents.  levels: the tables the
    nodes come from.  root_node and root: name and hex digest of the root; None for an empty table."""

    runs: DataFrame
    nodes: DataFrame | None
    root_node: str | None
    root: str | None


def raised(now: DataFrame) -> DataFrame:
    """The parents of the nodes (tree, level, place, node, hash, runs, left) of one level, with their children; ``left`` is how many nodes the
    tree has on the level."""
    kid = F.struct("place", "node", "hash", "runs")
    grouped = now.groupBy("tree", "level", F.floor(F.col("place") / FANOUT).alias("up")).agg(
        F.sort_array(F.collect_list(kid)).alias("kids"), F.sum("runs").alias("runs"), F.max("left").alias("was")
    )
    up = F.col("level") + 1
    return grouped.select(
        "tree", up.alias("level"), F.col("up").alias("place"), name(F.col("tree"), up, F.col("up")).alias("node"),
        hashed(joined(F.transform("kids", lambda k: k["hash"]))).alias("hash"), "runs", F.ceil(F.col("was") / FANOUT).alias("left"), "kids",
    )


NODE = ["tree", "level", "place", "node", "hash", "runs", "left"]


def climbed(start: DataFrame, most: int, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(the levels above, the tops of the trees) of nodes whose largest tree has ``most`` nodes."""
    levels, tops, now = [], [start.filter("left = 1")], start
    while most > 1:
        most = -(-most // FANOUT)
        level = stage(raised(now.filter("left > 1").select(NODE)), f"merkle-{label}")
        levels.append(level)
        tops.append(level.filter("left = 1").select(NODE))
        now = level
    return levels, tops


def linked(level: DataFrame, to_root: bool) -> DataFrame:
    """The node rows of the children of a level: the siblings on either side, the parent, in as many copies as runs need."""
    opened = level.select("node", "runs", "kids", F.posexplode("kids").alias("at", "kid"))
    hashes = lambda kids: joined(F.transform(kids, lambda k: k["hash"]))
    copies = lambda runs: F.ceil(runs / RUNS_A_COPY).cast("long")
    return opened.select(
        F.col("kid.node").alias("node"), F.col("node").alias("parent"), copies(F.col("runs")).alias("parent_copies"),
        hashes(F.slice("kids", F.lit(1), F.col("at"))).alias("before"), hashes(F.slice("kids", F.col("at") + 2, F.lit(FANOUT))).alias("after"),
        (F.col("kid.hash") if to_root else F.lit(None).cast("binary")).alias("subroot"),
        F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("kid.runs")) - 1)).alias("copy"),
    )


def build(docs: DataFrame, **columns) -> Manifest:
    """Hash the rows into runs, levels and the root, each a table in the shared folder."""
    member = F.struct("place", "doc_id", "leaf", "tampered")
    runs = placed(leaves(docs, **columns)).groupBy("number", F.floor(F.col("place") / FANOUT).alias("run")).agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.max("total").alias("total")
    )
    runs = stage(runs, "merkle-runs")
    most, sources = runs.agg(F.max("total"), F.count_distinct("number")).first()
    if most is None:
        return Manifest(runs, None, None, None)
    lone = F.col("total") == 1
    level = F.when(lone, 0).otherwise(1)
    first = runs.select(
        F.col("number").cast("string").alias("tree"), level.alias("level"), F.col("run").alias("place"),
        name(F.col("number").cast("string"), level, F.col("run")).alias("node"),
        F.when(lone, F.col("members")[0]["leaf"]).otherwise(hashed(joined(F.transform("members", lambda m: m["leaf"])))).alias("hash"),
        F.lit(1).cast("long").alias("runs"), F.when(lone, 1).otherwise(F.ceil(F.col("total") / FANOUT)).alias("left"),
    )
    own, tops = climbed(first, -(-most // FANOUT), "level")
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    subroots = subroots.select(
        F.lit("top").alias("tree"), F.lit(0).alias("level"), F.col("tree").cast("long").alias("place"), "node", "hash", "runs", F.lit(sources).cast("long").alias("left")
    )
    above, ends = climbed(subroots, sources, "top")
    nodes = None
    for number, made in enumerate([*own, *above]):
        rows = linked(made, number == len(own))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    root = ends[-1].select("node", F.lower(F.hex("hash"))).first()
    return Manifest(runs, stage(nodes, "merkle-nodes") if nodes is not None else None, *root)


@contextmanager
def unlimited_recursion(spark: SparkSession):
    """Lift the row limit of recursive queries, whose rows here grow with the table, for what is run inside."""
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, before)


CLIMB = """
WITH RECURSIVE climb (number, run, node, copy, folded, proof, subroot) AS (
    SELECT * FROM {start}
    UNION ALL
    SELECT c.number, c.run, n.parent, pmod(xxhash64(c.number, c.run), n.parent_copies),
           transform(c.folded, f -> unhex(sha2(lower(hex(concat(n.before, f, n.after))), 256))),
           concat(c.proof, n.before, n.after), coalesce(c.subroot, n.subroot)
    FROM climb c JOIN {nodes} n ON n.node = c.node AND n.copy = c.copy
)
SELECT number, run, folded, proof, subroot FROM climb WHERE node = {root}
"""


def ascend(manifest: Manifest) -> DataFrame:
    """number, run, folded, proof, subroot: for each run the roots its leaves come to, the siblings met above the run and the digest of its subroot
    (NULL if that is the root)."""
    spark = manifest.runs.sparkSession
    lone = F.col("total") == 1
    now = lambda m: F.coalesce(m["tampered"], m["leaf"])
    swapped = lambda i: F.transform("members", lambda m, j: F.when(i == j, now(m)).otherwise(m["leaf"]))
    folded = F.transform("members", lambda m, i: F.when(lone, now(m)).otherwise(hashed(joined(swapped(i)))))
    start = manifest.runs.select(
        "number", "run", name(F.col("number").cast("string"), F.when(lone, 0).otherwise(1), F.col("run")).alias("node"),
        F.lit(0).cast("long").alias("copy"), folded.alias("folded"), F.lit(b"").alias("proof"), F.lit(None).cast("binary").alias("subroot"),
    )
    if manifest.nodes is None:  # one run: it is the root
        return start.select("number", "run", "folded", "proof", "subroot")
    with unlimited_recursion(spark):
        return stage(spark.sql(CLIMB, start=start, nodes=manifest.nodes, root=manifest.root_node), "merkle-climb")


def verify(manifest: Manifest) -> DataFrame:
    """One row for each leaf: its digest, subroot and root, the digest of its proof, and the root that it folds to after the tampering."""
    spark = manifest.runs.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], RESULT)
    text = lambda digest: F.lower(F.hex(digest))
    rows = manifest.runs.select("number", "run", "members").join(ascend(manifest), ["number", "run"])
    rows = rows.select("*", F.posexplode("members").alias("at", "own"))
    siblings = joined(F.transform(F.filter("members", lambda m, i: i != F.col("at")), lambda m: m["leaf"]))
    return rows.select(
        F.col("own.doc_id").alias("doc_id"), text(F.col("own.leaf")).alias("leaf"),
        F.coalesce(text(F.col("subroot")), F.lit(manifest.root)).alias("subroot"), F.lit(manifest.root).alias("root"),
        F.sha2(F.lower(F.hex(F.concat(siblings, "proof"))), 256).alias("proof_sha256"),
        text(F.get("folded", F.col("at"))).alias("folded_root"),
        (text(F.get("folded", F.col("at"))) == manifest.root).alias("verified"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(build(table(spark, sf_dir, "documents")))


def crc32_sql(codes: str, crc_table: str = "crc.t") -> str:
    """DuckDB expression for the unsigned crc32 of a list of byte values."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, {crc_table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


#: One row whose list ``t`` holds the 256 steps of crc32 (reflected polynomial 0xEDB88320).
CRC_TABLE = """crc AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
)"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:-1]) + " || {text})"

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
rows_ AS (
    SELECT doc_id, source, {_LEAF.format(text=_FIELD.format("text"))} AS leaf,
           CASE WHEN {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 5 = 0
                THEN {_LEAF.format(text=_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')"))} END AS tampered
    FROM documents, crc
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n
    FROM rows_
), own(tree, level, place, h, n) AS (
    SELECT tree, 0, place, leaf, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 15) // 16)
    FROM own WHERE n > 1 GROUP BY tree, level, place // 16
), above(tree, level, place, h, n) AS (
    SELECT -1, 0, tree, h, (SELECT count(DISTINCT tree) FROM leaves) FROM own WHERE n = 1
    UNION ALL
    SELECT tree, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 15) // 16)
    FROM above WHERE n > 1 GROUP BY tree, level, place // 16
), nodes AS (
    SELECT tree, level, place, n, h FROM own WHERE n > 1 UNION ALL SELECT tree, level, place, n, h FROM above WHERE n > 1
), linked AS (
    SELECT tree, level, place,
           coalesce(string_agg(h, '') OVER (run ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(h, '') OVER (run ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after,
           (n + 15) // 16 AS left_
    FROM nodes WINDOW run AS (PARTITION BY tree, level, place // 16)
), start AS (
    SELECT row_number() OVER () AS id, doc_id, tree AS source_no, n, place, leaf, coalesce(tampered, leaf) AS h FROM leaves
), climb(id, tree, level, place, h, proof) AS (
    SELECT id, CASE WHEN n = 1 THEN -1 ELSE source_no END, 0, CASE WHEN n = 1 THEN source_no ELSE place END, h, '' FROM start
    UNION ALL
    SELECT c.id, CASE WHEN l.left_ = 1 AND l.tree >= 0 THEN -1 ELSE c.tree END,
           CASE WHEN l.left_ = 1 AND l.tree >= 0 THEN 0 ELSE c.level + 1 END,
           CASE WHEN l.left_ = 1 AND l.tree >= 0 THEN l.tree ELSE c.place // 16 END,
           sha256(l.before || c.h || l.after), c.proof || l.before || l.after
    FROM climb c JOIN linked l ON l.tree = c.tree AND l.level = c.level AND l.place = c.place
), arrived AS (
    SELECT id, arg_max(c.h, strlen(c.proof)) AS folded_root, arg_max(c.proof, strlen(c.proof)) AS proof
    FROM climb c JOIN above a ON a.tree = c.tree AND a.level = c.level AND a.place = c.place AND a.n = 1 GROUP BY id
)
SELECT s.doc_id, s.leaf, t.h AS subroot, r.h AS root, sha256(a.proof) AS proof_sha256, a.folded_root, a.folded_root = r.h AS verified
FROM start s JOIN arrived a USING (id) JOIN own t ON t.tree = s.source_no AND t.n = 1, (SELECT h FROM above WHERE n = 1) r
"""
