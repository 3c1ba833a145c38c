"""Proposed patches: do they apply, what do they produce, what did the review decide.

Positions are exact: the search for a shifted position is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import held, let
from ..functions.keys import may_meet
from ..functions.ranking import add_rank
from ..functions.text import severity_name
from ..functions.times import rfc3339
from ..session import stage
from .diffs import file_sections, hunk_rows, lines_of_hunks

ID = ("scan_id", "finding_ord")
_FILE = ("scan_id", "path")
_HUNK = (*ID, "file_ord", "hunk_ord")
#: Moves of a run of the sweep.
SWEEP_RUN = 512


def rank_findings(findings: DataFrame) -> DataFrame:
    """Findings with their position in the scan, ``finding_ord`` from 1.

    Counts and positions both read the findings, which are staged, so that nothing is searched twice.
    """
    found, _ = stage(findings, "unranked")
    return add_rank(
        found, ["scan_id"], ["phase", "file_ord"], ["hunk_ord", "line_ord", "rule_ord"],
        "finding_ord",
    ).withColumn("finding_ord", F.col("finding_ord").cast("bigint"))


def _hunks(patches: DataFrame) -> DataFrame:
    diffs = patches.select(*ID, F.col("patch").alias("raw"))
    return hunk_rows(file_sections(diffs, ID), ID)


def _lines(content: Column) -> Column:
    """The lines of a file; a final line end starts no further line."""
    return F.split(F.when(F.endswith(content, F.lit("\n")), F.left(content, F.length(content) - 1)).otherwise(content), "\n")


def _with_lines(repo_files: DataFrame, touched: DataFrame) -> DataFrame:
    """The files of ``touched`` (one row each, with any other columns) as lists of lines."""
    files = may_meet(repo_files.where(~F.col("is_dir")), touched, list(_FILE))
    own = files.select(*_FILE, "content").join(touched, list(_FILE))
    # behind a generator the text is cut once, however many columns read the lines
    return own.withColumn("lines", held(_lines(F.col("content")))).drop("content")


def _file_lines(repo_files: DataFrame, touched: DataFrame) -> DataFrame:
    """Numbered lines of the touched files."""
    return _with_lines(repo_files, touched.select(*_FILE).distinct()).select(
        *_FILE, F.posexplode("lines").alias("_pos", "content")
    ).select(*_FILE, (F.col("_pos") + 1).cast("bigint").alias("old_number"), "content")


def patch_check(patches: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Does each patch apply: it parses, its counts are right, its files exist, and every
    old-side line equals the file's line at that position.

    Old-side lines join file lines on (scan, path, line number), so the work is linear
    in the lines however many patches touch one file.
    """
    hunks, _ = stage(_hunks(patches), "patch-hunks")
    lines = lines_of_hunks(hunks, ID).select(*_HUNK, "path", "kind", "content", "old_number")
    asked = lines.where(F.col("kind") != "add").groupBy(*_FILE).agg(F.collect_set("old_number").alias("_asked"))
    met = _with_lines(repo_files, hunks.select(*_FILE).distinct().join(asked, list(_FILE), "left"))
    files, _ = stage(
        met.select(
            *_FILE, F.size("lines").alias("n_lines"),
            F.transform(
                F.filter("_asked", lambda n: (n > 0) & (n <= F.size("lines"))),
                lambda n: F.struct(n.alias("old_number"), F.get("lines", (n - 1).cast("int")).alias("_have")),
            ).alias("_old"),
        ),
        "asked-lines",
    )
    sizes = files.select(*_FILE, "n_lines")
    have = files.select(*_FILE, F.inline("_old"))
    old = F.col("kind") != "add"
    compared = lines.join(have, [*_FILE, "old_number"], "left")
    per_hunk = compared.groupBy(*_HUNK).agg(
        F.bool_and(~old | F.coalesce(F.col("content") == F.col("_have"), F.lit(False))).alias("same"),
        F.count_if(old).alias("n_old"),
        F.count_if(F.col("kind") != "del").alias("n_new"),
    )
    rated = hunks.join(per_hunk, list(_HUNK), "left").join(sizes, list(_FILE), "left")
    fits = (
        (F.coalesce("n_old", F.lit(0)) == F.col("old_count"))
        & (F.coalesce("n_new", F.lit(0)) == F.col("new_count"))
        & F.coalesce("same", F.lit(False))
        & F.coalesce(F.col("old_start") <= F.col("n_lines"), F.lit(False))
    )
    good = rated.groupBy(*ID).agg(F.bool_and(fits).alias("applies"))
    return patches.select(*ID).join(good, list(ID), "left").select(
        *ID, F.coalesce("applies", F.lit(False)).alias("applies")
    )


def _edits(hunks: DataFrame) -> DataFrame:
    """Lines of hunks with ``at``: the old line itself, or for an added line the old line
    it comes after."""
    lines = lines_of_hunks(hunks, ID)
    # One hunk is a piece of one patch text, so this window is bounded by one input row.
    so_far = (
        Window.partitionBy(*_HUNK).orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    )
    starts = hunks.select(
        *_HUNK,
        (F.col("old_start") - F.when(F.col("old_count") > 0, 1).otherwise(0)).alias("_before"),
        (F.col("old_start") + F.col("old_count") - 1).alias("_end"),
    )
    placed = lines.withColumn(
        "_seen", F.max(F.when(F.col("kind") != "add", F.col("old_number"))).over(so_far)
    )
    return placed.join(starts, list(_HUNK)).select(
        *_HUNK, "line_ord", "path", "kind", "content",
        F.coalesce("_seen", "_before").alias("at"), "_end",
    )


def _point(kind: str, at: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), at.alias("at"))


def _footprint(edits: DataFrame) -> DataFrame:
    """The points that each patch reads or writes: lines, and gaps after lines.

    A patch reads its old lines and the gaps between them; it writes the lines it
    deletes and the gaps it inserts into.  One pass over the edits gives both.
    """
    line, gap = _point("line", F.col("at")), _point("gap", F.col("at"))

    def touch(point: Column, reads: bool, writes: Column) -> Column:
        return F.struct(point.alias("point"), F.lit(reads).alias("reads"), writes.alias("writes"))

    own = touch(line, True, F.col("kind") == "del")
    between = touch(gap, True, F.lit(False))
    touched = (
        F.when(F.col("kind") == "add", F.array(touch(gap, False, F.lit(True))))
        .when(F.col("at") < F.col("_end"), F.array(own, between))
        .otherwise(F.array(own))
    )
    return edits.select(*ID, "path", F.inline(touched)).groupBy(*ID, "path", "point").agg(
        F.bool_or("reads").alias("reads"), F.bool_or("writes").alias("writes")
    )


def _contested(points: DataFrame) -> DataFrame:
    """Points that a patch reads and an earlier patch writes, with all who touch them and
    ``last_read``, the last patch that reads the point."""
    place = [*_FILE, "point"]
    met = points.groupBy(*place).agg(
        F.min(F.when(F.col("writes"), F.col("finding_ord"))).alias("_first"),
        F.max(F.when(F.col("reads"), F.col("finding_ord"))).alias("last_read"),
    ).where(F.col("_first") < F.col("last_read"))
    return points.join(met.drop("_first"), place)


def _sweep(moves: Column) -> Column:
    """Numbers of the patches that fail, from moves in order.

    ``open`` holds the written points that a later patch still reads; a point leaves it after its
    last reader, so a step costs what lies open there, not all that was written before.  The
    failed ones are gathered in runs of ``SWEEP_RUN`` moves, because appending copies a list.
    """

    def step(state: Column, move: Column) -> Column:
        live = F.filter(state["open"], lambda p: p["last_read"] >= move["finding_ord"])

        def judged(now: Column) -> Column:
            fails = F.arrays_overlap(F.transform(now, lambda p: p["name"]), move["reads"])
            return F.struct(now.alias("open"), fails.alias("fails"))

        def moved(seen: Column) -> Column:
            return F.struct(
                F.when(seen["fails"], seen["open"])
                .otherwise(F.array_union(seen["open"], move["writes"])).alias("open"),
                F.when(seen["fails"], F.array_append(state["lost"], move["finding_ord"]))
                .otherwise(state["lost"]).alias("lost"),
            )

        return let(let(live, judged), moved)

    nobody = F.array().cast("array<bigint>").alias("lost")

    def run(state: Column, part: Column) -> Column:
        start = F.struct(state["open"].alias("open"), nobody)
        return let(
            F.aggregate(part, start, step),
            lambda end: F.struct(
                end["open"].alias("open"), F.concat(state["lost"], end["lost"]).alias("lost")
            ),
        )

    runs = F.transform(
        F.sequence(F.lit(1), F.size(moves), F.lit(SWEEP_RUN)), lambda i: F.slice(moves, i, F.lit(SWEEP_RUN))
    )
    none = F.struct(F.array().cast("array<struct<name:string,last_read:bigint>>").alias("open"), nobody)
    return F.aggregate(runs, none, run, lambda s: s["lost"])


def failing(points: DataFrame) -> DataFrame:
    """scan_id, finding_ord of the patches that an earlier applied one keeps out.

    ``points``: who reads and writes which place of which file.  The moves of one file (of one
    scan, where a patch spans files) are swept in order.
    """
    name = F.concat_ws(":", "path", "point.kind", F.col("point.at").cast("string"))
    later = F.col("writes") & (F.col("last_read") > F.col("finding_ord"))
    moves = _contested(points).groupBy(*ID).agg(
        F.collect_list(F.when(F.col("reads"), name)).alias("reads"),
        F.collect_list(F.when(later, F.struct(name.alias("name"), "last_read"))).alias("writes"),
        F.min("path").alias("path"), F.max("path").alias("_last"),
    )
    spans = F.max(F.when(F.col("path") != F.col("_last"), 1).otherwise(0))
    whole = spans.over(Window.partitionBy("scan_id")) == 1
    moves = moves.withColumn("part", F.when(whole, F.lit("")).otherwise(F.col("path")))
    ordered = moves.groupBy("scan_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("finding_ord", "reads", "writes"))).alias("moves")
    )
    # behind a generator the sorted list is built once, not once for each run
    return ordered.select("scan_id", held(F.col("moves")).alias("moves")).select(
        "scan_id", F.explode(_sweep(F.col("moves"))).alias("finding_ord")
    )


def apply_order(accepted: DataFrame) -> DataFrame:
    """Outcome of applying patches one after the other: scan_id, finding_ord, applied.

    A patch fails when an earlier applied patch changed what it reads.  Patches meet
    through the points they touch, never pairwise, and only contested points matter.  Whether
    a patch goes in depends on all that went in before it, so the points are swept in the
    order of the patches.
    """
    points, _ = stage(_footprint(_edits(_hunks(accepted))), "patch-points")
    failed = failing(points).withColumn("_failed", F.lit(True))
    return accepted.select(*ID).join(failed, list(ID), "left").select(
        *ID, F.col("_failed").isNull().alias("applied")
    )


def accepted_patches(decisions: DataFrame, patches: DataFrame, checks: DataFrame) -> DataFrame:
    """Patches the review chose to apply and that apply on their own."""
    chosen = decisions.where(F.col("decision") == "apply").select(*ID)
    return patches.join(checks.where("applies").select(*ID), list(ID), "left_semi").join(
        chosen, list(ID), "left_semi"
    )


def patched_files(applied: DataFrame, repo_files: DataFrame) -> DataFrame:
    """New text of every file changed by the given patches."""
    # parsed once: kept lines, inserts and the list of files all read the edits
    edits, _ = stage(_edits(_hunks(applied)).where(F.col("kind") != "ctx"), "patch-edits")
    inserts = edits.where(F.col("kind") == "add").select(
        *_FILE, "at", "finding_ord", "line_ord", "content"
    )
    deleted = edits.where(F.col("kind") == "del").select(*_FILE, F.col("at").alias("old_number"))
    kept = _file_lines(repo_files, edits).join(
        deleted.distinct(), [*_FILE, "old_number"], "left_anti"
    )
    zero = F.lit(0).cast("bigint")
    rows = kept.select(
        *_FILE, F.col("old_number").alias("at"), zero.alias("finding_ord"),
        F.lit(0).alias("line_ord"), "content",
    ).unionByName(inserts)
    # One row per changed file is the result itself, so collecting a file's lines is bounded
    # by the size of that file.
    texts = rows.groupBy(*_FILE).agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("at", "finding_ord", "line_ord", "content"))
                ),
                lambda x: x["content"],
            ),
            "\n",
        ).alias("body")
    )
    ends = repo_files.select(*_FILE, F.endswith("content", F.lit("\n")).alias("_nl"))
    # A file whose every line was deleted has no row in ``texts`` and becomes empty.
    return (
        edits.select(*_FILE).distinct().join(texts, list(_FILE), "left")
        .join(ends, list(_FILE))
        .select(
            *_FILE,
            F.when(F.col("body").isNull(), F.lit(""))
            .when(F.col("_nl"), F.concat("body", F.lit("\n")))
            .otherwise(F.col("body"))
            .alias("content"),
        )
    )


def patch_apply(
    decisions: DataFrame, patches: DataFrame, repo_files: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, files): which accepted patches went in, and the files they produce.

    The accepted patches and the outcomes (ids only) are staged: every branch of the result reads them, and none
    checks patches or settles their order again.
    """
    accepted, _ = stage(accepted_patches(decisions, patches, patch_check(patches, repo_files)), "accepted-patches")
    outcomes, _ = stage(apply_order(accepted), "patch-outcomes")
    done = outcomes.where("applied").select(*ID)
    return outcomes, patched_files(accepted.join(done, list(ID), "left_semi"), repo_files)


def review_outcomes(findings: DataFrame, patches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Audit row of every finding of the scans under review.

    A review happens for scans with at least one proposed patch.  Findings that were not
    chosen, have no usable patch, or come after the reviewer stopped are skipped.
    """
    reviewed = patches.where(F.col("patch") != "").select("scan_id").distinct()
    done = outcomes.select(*ID, "applied")
    action = (
        F.when(F.col("applied"), F.lit("apply"))
        .when(~F.col("applied"), F.lit("apply_failed"))
        .otherwise(F.lit("skip"))
    )
    return (
        findings.join(reviewed, "scan_id", "left_semi")
        .join(done, list(ID), "left")
        .select(
            *ID, action.alias("action"), "rule_id", "path", "line",
            severity_name(F.col("severity")).alias("severity"), "source", "message",
        )
    )


def review_audit(outcomes: DataFrame, scans: DataFrame) -> DataFrame:
    """Review outcomes as rows of the audit log: with the repository and time of their scan.
    ``scans``: scan_id, repo, scan_ts."""
    placed = outcomes.join(scans.select("scan_id", "repo", "scan_ts"), "scan_id")
    return placed.select(
        "repo", rfc3339(F.col("scan_ts")).alias("timestamp"), "action", "rule_id", "path", "line",
        "severity", "source", "message",
    )


def review_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of each review: chosen, applied and skipped findings."""
    action = F.col("action")
    return outcomes.groupBy("scan_id").agg(
        F.count_if(action.isin("apply", "apply_failed")).alias("n_chosen"),
        F.count_if(action == "apply").alias("n_applied"),
        F.count_if(action == "skip").alias("n_skipped"),
    )
