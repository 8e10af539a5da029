"""Comparison of a new listing (stage) with the committed baseline, renames and merging.

All joins are equi joins on the catalogue key; null-safe comparisons of values
are post-join expressions, and null handles never take part in handle joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, null_eq
from ..shared import settle
from .dedup import latest_by_key

KEY = ["relative_path", "version_id"]


def _prefixed(df: DataFrame, keep: list[str], prefix: str = "old_") -> DataFrame:
    return df.select(*[F.col(x).alias(x if x in keep else prefix + x) for x in df.columns])


def new_by_path(stage: DataFrame, base: DataFrame) -> DataFrame:
    return stage.join(base.where("confirmed"), KEY, "left_anti")


def new_by_copy_path(stage: DataFrame, base: DataFrame) -> DataFrame:
    """Also new if the kind or the identity at the path was replaced."""
    known = base.where("confirmed").select(*KEY, F.coalesce("file_handle", F.lit("")).alias("_h"), "entry_kind")
    return stage.withColumn("_h", F.coalesce("file_handle", F.lit(""))).join(known, [*KEY, "_h", "entry_kind"], "left_anti").select(*stage.columns)


def new_by_handle(stage: DataFrame, base: DataFrame) -> DataFrame:
    """Unknown handle, or a known path under another handle; null handles compare by path."""
    old = base.where("confirmed")
    paths = old.select(*KEY, F.col("file_handle").alias("_old"), F.lit(True).alias("_seen"))
    handles = old.where("file_handle is not null").select("file_handle").distinct().withColumn("_known", F.lit(True))
    joined = stage.join(paths, KEY, "left").join(handles, "file_handle", "left")
    seen, same = F.coalesce("_seen", F.lit(False)), null_eq("file_handle", "_old")
    fresh = F.when(F.col("file_handle").isNull(), ~seen | ~same).otherwise(F.col("_known").isNull() | (seen & ~same))
    return joined.where(fresh).select(*stage.columns)


def data_differs(mode: str = "copy") -> Column:
    """Files: size or mtime (copy mode also source version and identity); any kind: the marker."""
    own = ~((F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime_ns")))
    if mode == "copy":
        own = own | ~((F.col("source_version_id") == F.col("old_source_version_id")) & (F.col("identity_key") == F.col("old_identity_key")))
    return (~F.col("is_dir") & own) | ~null_eq("marker_state", "old_marker_state")


def metadata_differs(mode: str = "copy") -> Column:
    out = ~(null_eq("mode", "old_mode") & null_eq("uid", "old_uid") & null_eq("gid", "old_gid")) | (F.col("metadata_digest") != F.col("old_metadata_digest"))
    out = out | (F.col("is_dir") & (F.col("mtime_ns") != F.col("old_mtime_ns")))
    return out | ~F.col("old_copy_path_confirmed") if mode == "copy" else out


def change(mode: str = "copy") -> Column:
    """The kind of change of a joined row; null is none."""
    removed = F.col("is_dir") & F.col("marker_state").isNull() & F.col("old_marker_state").isNotNull()
    data, meta = data_differs(mode), metadata_differs(mode)
    return F.when(removed, "directory_marker_removed").when(data & meta, "both_changed").when(data, "data_changed").when(meta, "metadata_changed")


def changed(stage: DataFrame, base: DataFrame, mode: str = "copy") -> DataFrame:
    """Stage rows of known paths with a change, and its kind."""
    joined = stage.join(_prefixed(base.where("confirmed"), KEY), KEY)
    return joined.withColumn("change", change(mode)).where("change is not null").select(*stage.columns, "change")


def classify(stage: DataFrame, base: DataFrame, mode: str = "copy") -> DataFrame:
    """Every stage row with its class: one left outer join, one case."""
    joined = stage.join(_prefixed(base.where("confirmed"), KEY).withColumn("_seen", F.lit(True)), KEY, "left")
    replaced = ~null_eq("file_handle", "old_file_handle") | (F.col("entry_kind") != F.col("old_entry_kind"))
    kind = F.when(F.col("_seen").isNull() | replaced, "new").otherwise(F.coalesce(change(mode), F.lit("unchanged")))
    return joined.select(*stage.columns, kind.alias("change"))


def force_copy(stage: DataFrame, base: DataFrame) -> DataFrame:
    """Every row is new, except a removed directory marker."""
    old = base.where("confirmed").select(*KEY, F.col("marker_state").alias("_m"))
    removed = F.col("is_dir") & F.col("marker_state").isNull() & F.col("_m").isNotNull()
    return stage.join(old, KEY, "left").select(*stage.columns, F.when(removed, "directory_marker_removed").otherwise("new").alias("change"))


def strategy(stage: DataFrame, base: DataFrame) -> DataFrame:
    """One row: ``handle`` if both sides have handles and none is legacy, else ``path``."""

    def facts(df: DataFrame, p: str) -> DataFrame:
        legacy = F.col("file_handle").isNotNull() & ~F.col("file_handle").startswith(HANDLE_PREFIX)
        return df.agg(F.coalesce(F.bool_or(F.col("file_handle").isNotNull()), F.lit(False)).alias(f"{p}_has"), F.coalesce(F.bool_or(legacy), F.lit(False)).alias(f"{p}_legacy"))

    both = facts(stage, "stage").join(facts(base.where("confirmed"), "base"))
    good = F.col("stage_has") & F.col("base_has") & ~F.col("stage_legacy") & ~F.col("base_legacy")
    return both.select(F.when(good, "handle").otherwise("path").alias("strategy"), "stage_has", "base_has", "stage_legacy", "base_legacy")


HANDLE_PREFIX = "54534934"
"""Fixed value: what stable handles begin with."""


def displaced_rows(stage: DataFrame, base: DataFrame) -> DataFrame:
    """Old rows whose path a staged entry with another stable handle has taken."""
    taken = stage.where("file_handle is not null").select(*KEY, F.col("file_handle").alias("_n"))
    return base.join(taken, KEY).where("file_handle <> _n").select(*base.columns)


def scan_compare(stage: DataFrame, base: DataFrame) -> DataFrame:
    """Scan-mode diff of a batch: changed kinds, ``new``, ``candidate`` (stable identity, absent or
    another one at its path) and, for reused paths, whether old rows are displaced."""
    joined = stage.join(_prefixed(base, KEY).withColumn("_seen", F.lit(True)), KEY, "left")
    absent = F.col("_seen").isNull()
    moved = ~absent & ~null_eq("file_handle", "old_file_handle")
    event = F.when((absent | moved) & F.col("file_handle").isNotNull(), "candidate").when(absent, "new").otherwise(F.coalesce(change("scan"), F.lit("unchanged")))
    return joined.select(*stage.columns, event.alias("event"), (moved & F.col("old_file_handle").isNotNull()).alias("displaced"))


def identity_changed(base: DataFrame, stage: DataFrame) -> DataFrame:
    """Base rows whose path still exists but none of its staged handles is theirs."""
    staged = stage.where("file_handle is not null").select(*KEY, F.col("file_handle").alias("_s"))
    joined = base.where("file_handle is not null").join(staged, KEY)
    same = joined.groupBy(*KEY, "file_handle").agg(F.max((F.col("file_handle") == F.col("_s")).cast("int")).alias("_same"))
    return same.where("_same = 0").drop("_same")


def final_renames(old: DataFrame, live: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The round's resolution by stable handle, over whole keys (path and version).

    A live candidate is a ``rename`` iff its handle has exactly one original key (old rows that are
    gone or displaced, logged deletions and logged renames' sources) and exactly one live alias,
    else ``new``; old rows that are no rename's source are ``deleted``.  Decisions that ``log``
    records (operation_type new or rename, the source's path in ``comment``) win.

    One full join of both sides on the key, one grouping by handle, one by key."""
    o = old.select(*KEY, F.col("file_handle").alias("_o"), F.lit(True).alias("_old"))
    n = live.select(*KEY, F.col("file_handle").alias("_n"), F.lit(True).alias("_live"))
    both = settle(o.join(n, KEY, "full"))  # joined once, read twice
    log = log if log is None else settle(log.select("operation_type", *KEY, "file_handle", "comment"))
    was, now = F.col("_old").isNotNull(), F.col("_live").isNotNull()
    left = was & F.coalesce(~now | (F.col("_o") != F.col("_n")), F.lit(False))
    fresh = now & (~was | (F.col("_n").isNotNull() & ~null_eq("_n", "_o")))
    key, no_key = F.struct(*KEY), F.lit(None).cast("struct<relative_path:string,version_id:string>")

    def role(handle: Column | str, original: Column, to: Column, alive: int) -> Column:
        return F.struct(c(handle).alias("handle"), original.alias("original"), to.alias("to"), F.lit(alive).alias("alive"))

    roles = F.array(F.when(left & F.col("_o").isNotNull(), role("_o", key, no_key, 0)), F.when(now & F.col("_n").isNotNull(), role("_n", no_key, F.when(fresh, key), 1)))
    handles = both.select(F.explode(F.array_compact(roles)).alias("r")).select("r.*")
    source = F.struct(F.col("comment").alias("relative_path"), "version_id")
    if log is not None:
        past = log.where("operation_type in ('deleted', 'rename') and file_handle is not null")
        handles = handles.unionByName(past.select(role("file_handle", F.when(F.col("operation_type") == "deleted", key).otherwise(source), no_key, 0).alias("r")).select("r.*"))
    per = handles.groupBy("handle").agg(F.min("original").alias("a"), F.max("original").alias("z"), F.max("to").alias("to"), F.sum("alive").alias("alive"))
    moves = per.where("a = z and alive = 1 and to is not null").select("to.*", F.col("a").alias("source"))
    if log is not None:
        decided = log.where("operation_type in ('new', 'rename')")
        moves = moves.join(decided.select(*KEY), KEY, "left_anti").unionByName(decided.where("operation_type = 'rename'").select(*KEY, source.alias("source")))
    no, yes = F.lit(False), F.lit(True)
    facts = both.where(left | fresh).select(*KEY, fresh.alias("fresh"), left.alias("left"), no.alias("used"), no_key.alias("source"))
    facts = facts.unionByName(moves.select(*KEY, no.alias("fresh"), no.alias("left"), no.alias("used"), "source"))
    facts = facts.unionByName(moves.select("source.*", no.alias("fresh"), no.alias("left"), yes.alias("used"), no_key.alias("source")))
    facts = facts.groupBy(*KEY).agg(*(F.bool_or(x).alias(x) for x in ("fresh", "left", "used")), F.max("source").alias("source"))

    def outcome(name: Column, origin: Column) -> Column:
        return F.struct(name.alias("outcome"), origin["relative_path"].alias("from_path"), origin["version_id"].alias("from_version"))

    moved = F.when(F.col("fresh"), outcome(F.when(F.col("source").isNotNull(), "rename").otherwise("new"), F.col("source")))
    gone = F.when(F.col("left") & ~F.col("used"), outcome(F.lit("deleted"), no_key))
    return facts.select(*KEY, F.explode(F.array_compact(F.array(moved, gone))).alias("r")).select(*KEY, "r.*")


def delta_events(stage: DataFrame, base: DataFrame) -> DataFrame:
    """The round's events (op, weight, size and kind flags) for counting: ``classify`` and
    ``final_renames`` of both sides in one full join and one grouping by handle.

    Every staged row counts by its class and every row that is gone or displaced as deleted.  A
    handle that is a rename then takes both of its rows back and counts one rename: weights of -1.
    Handles are grouped over numbers alone; keys are told apart by 128 bits of hashes."""
    flags = ("is_dir", "is_symlink", "is_regular_file")
    new = stage.withColumn("_live", F.lit(True))
    old = _prefixed(base, KEY).withColumn("_old", F.lit(True))
    both = new.join(old, KEY, "full")
    was, now = F.col("_old").isNotNull(), F.col("_live").isNotNull()
    o, n = F.col("old_file_handle"), F.col("file_handle")
    seen = was & F.coalesce(F.col("old_confirmed"), F.lit(False))
    replaced = ~null_eq("file_handle", "old_file_handle") | (F.col("entry_kind") != F.col("old_entry_kind"))
    kind = F.when(~seen | replaced, "new").otherwise(F.coalesce(change(), F.lit("unchanged")))
    left = was & F.coalesce(~now | (o != n), F.lit(False))
    fresh = now & (~was | (n.isNotNull() & ~null_eq("file_handle", "old_file_handle")))
    row = lambda p: F.struct(F.col(f"{p}size").alias("size"), *(F.col(p + x).alias(x) for x in flags))
    rows = both.select(
        F.xxhash64(*KEY).alias("_k1"), F.xxhash64(F.lit(1), *KEY).alias("_k2"), n.alias("_n"), o.alias("_o"), F.when(now, F.array_position(F.array(*map(F.lit, CLASSES)), kind).cast("int")).alias("_class"), left.alias("_left"), fresh.alias("_fresh"), row("").alias("_new"), row("old_").alias("_was"),
    )
    rows = settle(rows.where("_class is not null or _left"))  # joined once, read twice
    events = F.array_compact(F.array(F.when(F.col("_class").isNotNull(), F.struct(F.col("_class").alias("class"), F.lit(1).alias("weight"), F.col("_new").alias("row"))), F.when(F.col("_left"), F.struct(F.lit(DELETED).alias("class"), F.lit(1).alias("weight"), F.col("_was").alias("row")))))
    plain = rows.select(F.explode(events).alias("e")).select("e.class", "e.weight", "e.row.*")

    role = lambda handle, gone, alive: F.struct(F.col(handle).alias("handle"), F.when(gone, F.col("_k1")).alias("k1"), F.when(gone, F.col("_k2")).alias("k2"), F.when(gone, F.col("_was")).alias("gone"), F.lit(alive).alias("alive"), F.when(~gone & F.col("_fresh"), F.col("_class")).alias("class"), F.when(~gone & F.col("_fresh"), F.col("_new")).alias("to"))
    roles = F.array_compact(F.array(F.when(F.col("_left") & F.col("_o").isNotNull(), role("_o", F.lit(True), 0)), F.when(F.col("_class").isNotNull() & F.col("_n").isNotNull(), role("_n", F.lit(False), 1))))
    per = rows.select(F.explode(roles).alias("r")).select("r.*").groupBy("handle").agg(
        *(f(c).alias(f"{c}_{name}") for c in ("k1", "k2") for name, f in (("a", F.min), ("z", F.max))), F.sum("alive").alias("alive"), F.max("class").alias("class"),
        *(F.max(F.col(f"{side}.{x}")).alias(f"{side}_{x}") for side in ("gone", "to") for x in ("size", *flags)),
    )
    moves = per.where("k1_a = k1_z and k2_a = k2_z and alive = 1 and class is not null")
    taken = lambda side, code, weight: F.struct(code.alias("class"), F.lit(weight).alias("weight"), *(F.col(f"{side}_{x}").alias(x) for x in ("size", *flags)))
    moved = moves.select(F.explode(F.array(taken("to", F.col("class"), -1), taken("to", F.lit(RENAMED), 1), taken("gone", F.lit(DELETED), -1))).alias("e")).select("e.*")
    names = F.array(*map(F.lit, (*CLASSES, "deleted", "rename")))
    return plain.unionByName(moved).withColumn("op", F.element_at(names, F.col("class"))).drop("class")


CLASSES = ("new", "data_changed", "metadata_changed", "both_changed", "directory_marker_removed", "unchanged")
DELETED, RENAMED = len(CLASSES) + 1, len(CLASSES) + 2


def delete_or_rename(old: DataFrame, pending: DataFrame) -> DataFrame:
    """Copy mode: a gone row without handle is deleted; with one pending row of its handle and kind
    at another path it is renamed; with several it is ``ambiguous``."""
    joined = old.alias("o").join(pending.where("file_handle is not null").alias("p"), (F.col("o.file_handle") == F.col("p.file_handle")) & (F.col("o.entry_kind") == F.col("p.entry_kind")) & (F.col("o.relative_path") != F.col("p.relative_path")), "left")
    per = joined.groupBy(F.col("o.relative_path").alias("relative_path"), F.col("o.version_id").alias("version_id")).agg(F.count("p.relative_path").alias("n"), F.min("p.relative_path").alias("to_path"))
    status = F.when(F.col("n") == 0, "deleted").when(F.col("n") == 1, "renamed").otherwise("ambiguous")
    return per.select(*KEY, status.alias("status"), F.when(F.col("n") == 1, F.col("to_path")).alias("to_path"))


def deleted(base: DataFrame, working: int) -> DataFrame:
    """Confirmed rows that the working generation has not seen."""
    return latest_by_key(base, KEY, "copy_sequence", "generation").where((F.col("generation") != working) & F.col("confirmed"))


def recovery_delete(old: DataFrame, observed: DataFrame) -> DataFrame:
    """A re-observed path's old row is ``retired``; others are ``deleted`` once per path."""
    seen = observed.select("relative_path").distinct().withColumn("_s", F.lit(True))
    return old.select("relative_path").distinct().join(seen, "relative_path", "left").select("relative_path", F.when(F.col("_s"), "retired").otherwise("deleted").alias("verdict"))


def merge_base(stage: DataFrame, base: DataFrame, excluded: DataFrame) -> DataFrame:
    """The next baseline.  Stage rows inherit confirmation only where the path keeps its handle;
    excluded keys of the stage are skipped, and their old rows come back as unconfirmed tombstones:
    the data flag stays for metadata-only changes, and removed markers' rows stay as they are."""
    old = base.select(*KEY, F.col("file_handle").alias("_h"), F.col("copy_data_confirmed").alias("_d"), F.col("copy_path_confirmed").alias("_p"), F.lit(True).alias("_seen"))
    merged = stage.join(excluded.select(*KEY), KEY, "left_anti").join(old, KEY, "left")
    same = F.coalesce(F.col("_seen") & null_eq("file_handle", "_h"), F.lit(False))
    merged = merged.withColumn("copy_data_confirmed", same & F.coalesce("_d", F.lit(False))).withColumn("copy_path_confirmed", same & F.coalesce("_p", F.lit(False))).select(*stage.columns)
    back = base.join(excluded.select(*KEY, F.col("change").alias("_c")), KEY)
    kept = F.col("_c") == "directory_marker_removed"
    back = back.withColumn("copy_data_confirmed", F.col("copy_data_confirmed") & (kept | (F.col("_c") == "metadata_changed"))).withColumn("copy_path_confirmed", F.col("copy_path_confirmed") & kept).select(*stage.columns)
    return latest_by_key(base.select(*stage.columns).unionByName(merged).unionByName(back.withColumn("copy_sequence", F.col("copy_sequence") + 1)), KEY, "copy_sequence", "generation")


def transfer_decision(source: DataFrame, target: DataFrame) -> DataFrame:
    """FullTransfer, DeltaTransfer, MetadataOnly or Skip per source entry; kind is part of the key."""
    t = _prefixed(target, ["relative_path", "is_dir"])
    joined = source.join(t.withColumn("_seen", F.lit(True)), ["relative_path", "is_dir"], "left")
    data = (F.col("mtime_ns") != F.col("old_mtime_ns")) | (F.col("size") != F.col("old_size"))
    meta = ~(null_eq("mode", "old_mode") & null_eq("uid", "old_uid") & null_eq("tags", "old_tags"))
    decision = F.when(F.col("_seen").isNull(), "FullTransfer").when(~F.col("is_dir") & data, "DeltaTransfer").when(meta, "MetadataOnly").otherwise("Skip")
    return joined.select(*source.columns, decision.alias("decision"))


def directory_markers(source: DataFrame, target: DataFrame, tags_required: bool = True) -> DataFrame:
    """Zero-byte directory objects: Skip if the target has the marker and its tags equal or are not needed."""
    marks = target.where("is_dir").select(F.concat("relative_path", F.lit("/")).alias("_key"), F.col("tags").alias("_t"), F.lit(True).alias("_seen"))
    joined = source.where("is_dir").withColumn("_key", F.concat("relative_path", F.lit("/"))).join(marks, "_key", "left")
    same = null_eq("tags", "_t") if tags_required else F.lit(True)
    return joined.select("relative_path", F.when(F.coalesce(F.col("_seen"), F.lit(False)) & same, "Skip").otherwise("FullTransfer").alias("decision"))


def orphans(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.join(source.select("relative_path", "is_dir"), ["relative_path", "is_dir"], "left_anti")


def by_handles(base: DataFrame, handles: DataFrame) -> DataFrame:
    """Rows of a bounded key set; Spark broadcasts it if it is small."""
    return base.join(handles.select("file_handle").where("file_handle is not null"), "file_handle", "left_semi")
