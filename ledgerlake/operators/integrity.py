"""Integrity and completeness checks between two sides, and plans that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import depth, name, parent

DATA_LABELS = ("entry_kind", "size", "mtime")
OWNERSHIP = ("uid", "gid", "mode", "hdfs_owner", "hdfs_group")
CONTENT_LABELS = ("entry_kind", "size", "read_length", "stream_offset", "content", "mtime")


def mtime_equal(a: Column, b: Column, mode: str = "exact", tolerance_ms: int = 0) -> Column:
    """Equal stamps: exact nanoseconds, or at the coarser of both stamps' own precisions; plus a tolerance."""
    if mode == "exact":
        return F.abs(a - b) <= tolerance_ms * 1_000_000
    unit = lambda x: F.when(x % 1_000_000_000 == 0, 1_000_000_000).when(x % 1_000_000 == 0, 1_000_000).when(x % 1_000 == 0, 1_000).otherwise(1)
    step = F.greatest(unit(a), unit(b))
    return F.abs(F.floor(a / step) - F.floor(b / step)) * step <= tolerance_ms * 1_000_000


def quick_check(source: DataFrame, target: DataFrame, mode: str = "exact", tolerance_ms: int = 0, content: bool = False) -> DataFrame:
    """Per source entry: ``ok``, ``missing`` or ``mismatch`` with its labels; data labels (kind, size,
    content) hide metadata ones (time, then ownership where both sides know it)."""
    t = target.select(*[F.col(x).alias(x if x == "relative_path" else f"t_{x}") for x in target.columns]).withColumn("_seen", F.lit(True))
    j = source.join(t, "relative_path", "left")
    known = lambda x: F.col(x).isNotNull() & F.col(f"t_{x}").isNotNull() & (F.col(x) != F.col(f"t_{x}"))
    same_kind = F.col("entry_kind") == F.col("t_entry_kind")
    data = [F.when(~same_kind, "entry_kind"), F.when(same_kind & (F.col("entry_kind") != "directory") & (F.col("size") != F.col("t_size")), "size")]
    if content:
        data.append(F.when(F.sha2("content", 256) != F.sha2("t_content", 256), "content"))
    meta = [F.when(~mtime_equal(F.col("mtime_ns"), F.col("t_mtime_ns"), mode, tolerance_ms), "mtime")]
    meta += [F.when(known(x), x) for x in OWNERSHIP if x in source.columns and x in target.columns]
    found, extra = F.array_compact(F.array(*data)), F.array_compact(F.array(*meta))
    labels = F.when(F.size(found) > 0, found).otherwise(extra)
    missing = F.col("_seen").isNull()
    return j.select(*source.columns, F.when(missing, "missing").when(F.size(labels) > 0, "mismatch").otherwise("ok").alias("status"), F.when(~missing, labels).otherwise(F.array().cast("array<string>")).alias("labels"))


def content_check(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per source file: ok, missing or mismatch by a strong hash of the content."""
    t = target.select("relative_path", F.sha2("content", 256).alias("_t"), F.lit(True).alias("_seen"))
    j = source.select("relative_path", F.sha2("content", 256).alias("_s")).join(t, "relative_path", "left")
    return j.select("relative_path", F.when(F.col("_seen").isNull(), "missing").when(F.col("_s").eqNullSafe(F.col("_t")), "ok").otherwise("mismatch").alias("status"))


def fix_plan(checked: DataFrame) -> DataFrame:
    """What repairing metadata alone can do for each issue."""
    hard = F.arrays_overlap("labels", F.array(*map(F.lit, CONTENT_LABELS)))
    return checked.where("status <> 'ok'").withColumn("fix", F.when((F.col("status") == "missing") | hard, "content").otherwise("metadata"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per path: missing, extra, kind or size mismatch, duplicate, or ok."""
    fold = lambda df, p: df.groupBy("relative_path").agg(F.count(F.lit(1)).alias(f"{p}_n"), F.min("entry_kind").alias(f"{p}_kind"), F.min("size").alias(f"{p}_size"))
    j = fold(expected, "e").join(fold(actual, "a"), "relative_path", "full")
    issue = F.when(F.col("a_n").isNull(), "missing").when(F.col("e_n").isNull(), "extra").when(F.col("a_n") > 1, "duplicate").when(F.col("e_kind") != F.col("a_kind"), "kind").when((F.col("e_kind") == "file") & (F.col("e_size") != F.col("a_size")), "size").otherwise("ok")
    return j.select("relative_path", issue.alias("issue"))


def manifest_summary(verified: DataFrame) -> DataFrame:
    """Counts of issues and whether the manifest passes."""
    n = lambda x: F.count_if(F.col("issue") == x).alias(x)
    return verified.agg(*map(n, ("missing", "extra", "duplicate", "kind", "size", "ok"))).withColumn("passed", F.expr("missing + extra + duplicate + kind + size = 0"))


def prefix_regressions(earlier: DataFrame, later: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of an attempt that the next one has not, or has changed."""
    return earlier.select(*columns).exceptAll(later.select(*columns))


def target_prune_plan(renames: DataFrame, deletions: DataFrame) -> DataFrame:
    """Physical work in a safe order: renames parent first, deletions deepest first; a child's move is
    redundant where its parent directory's rename already takes it there under the same name."""
    r = renames.select(F.col("from_path"), F.col("to_path"), parent("from_path").alias("_fp"), parent("to_path").alias("_tp"))
    p = renames.where("is_dir").select(F.col("from_path").alias("_fp"), F.col("to_path").alias("_tp"), F.lit(True).alias("_moved"))
    moves = r.join(p, ["_fp", "_tp"], "left")
    redundant = F.coalesce("_moved", F.lit(False)) & (name("from_path") == name("to_path"))
    moves = moves.select(F.lit(0).alias("rank"), F.lit("rename").alias("action"), F.col("from_path").alias("path"), "to_path", depth("from_path").cast("long").alias("order_depth"), redundant.alias("redundant"))
    drops = deletions.select(F.lit(1).alias("rank"), F.lit("delete").alias("action"), F.col("relative_path").alias("path"), F.lit(None).cast("string").alias("to_path"), (-depth("relative_path")).cast("long").alias("order_depth"), F.lit(False).alias("redundant"))
    return moves.unionByName(drops)


def source_cleanup(entries: DataFrame, target: DataFrame, source_now: DataFrame, execution: str) -> DataFrame:
    """Whether an entry's source may be removed, or the reason it is kept: the storage root and
    virtual entries are no one's; the entry was confirmed by this execution; a history is complete
    and has nothing but its latest version; no directory marker; the target has the same kind,
    size (files) and link target (links); the source is still there with the metadata it had."""
    t = target.select("relative_path", F.col("entry_kind").alias("_tk"), F.col("size").alias("_ts"), F.col("symlink_target").alias("_tl"), F.lit(True).alias("_t"))
    facts = ("size", "mtime_ns", "mode", "uid")
    s = source_now.select("relative_path", *[F.col(x).alias(f"_s_{x}") for x in facts], F.lit(True).alias("_s"))
    j = entries.join(t, "relative_path", "left").join(s, "relative_path", "left")
    kept = F.lit(True)
    for x in facts:
        kept = kept & F.col(x).eqNullSafe(F.col(f"_s_{x}"))
    link = (F.col("entry_kind") == "symlink") & ~F.col("symlink_target").eqNullSafe(F.col("_tl"))
    verdict = (
        F.when((F.col("relative_path") == "") | F.col("is_virtual"), "source_cleanup_policy")
        .when(~F.col("confirmed") | ~F.col("confirmed_by").eqNullSafe(F.lit(execution)), "stale_evidence")
        .when((F.col("history_records") > 0) & ~F.col("history_complete"), "incomplete_enumeration")
        .when(F.col("history_records") > 1, "source_cleanup_policy")
        .when(F.col("marker_state").isNotNull(), "source_deletion_unconfirmed")
        .when(F.col("_t").isNull() | (F.col("_tk") != F.col("entry_kind")) | ((F.col("entry_kind") == "file") & (F.col("_ts") != F.col("size"))) | link, "target_persistence_unconfirmed")
        .when(F.col("_s").isNull(), "already_absent")
        .when(~kept, "source_deletion_unconfirmed")
        .otherwise("eligible")
    )
    return j.select("relative_path", verdict.alias("verdict"))


def absence_verdict(entries: DataFrame, presence: DataFrame) -> DataFrame:
    """Whether a target may go: only where the source is confirmed absent; else the reason it stays."""
    p = presence.select("relative_path", F.col("state").alias("_p"))
    odd = (F.col("relative_path") == "") | F.col("has_history") | F.col("marker_state").isNotNull()
    verdict = F.when(odd, "keep:source_deletion_unconfirmed").when(F.col("_p") == "absent", "delete").when(F.col("_p") == "present", "keep:source_deletion_unconfirmed").otherwise("keep:source_query_failed")
    return entries.join(p, "relative_path", "left").select("relative_path", verdict.alias("verdict"))
