"""Distributions, counts and reports over a catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from .dedup import latest_by_key


def _n(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0)).cast("long")


def _sum(value: Column | str, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, fn.c(value))), F.lit(0)).cast("long")


def summary_counts(df: DataFrame) -> DataFrame:
    """Directories, files and links with bytes, depths over directories, name lengths in bytes."""
    d, f, l = F.col("is_dir"), F.col("is_regular_file"), F.col("is_symlink") & ~F.col("is_dir")
    deep, long_ = fn.depth("relative_path"), F.octet_length(fn.name("relative_path"))
    return df.agg(
        _n(d).alias("dirs"), _sum("size", d).alias("dir_bytes"), _n(f).alias("files"), _sum("size", f).alias("file_bytes"), _n(l).alias("links"), _sum("size", l).alias("link_bytes"),
        _sum(deep, d).alias("total_depth"), F.coalesce(F.max(F.when(d, deep)), F.lit(0)).cast("long").alias("max_depth"), F.coalesce(F.sum(long_), F.lit(0)).cast("long").alias("total_name"), F.coalesce(F.max(long_), F.lit(0)).cast("long").alias("max_name"),
    )


def other_kinds(df: DataFrame) -> DataFrame:
    """Entries that are neither directory, regular file nor link."""
    other = ~F.col("is_dir") & ~F.col("is_regular_file") & ~F.col("is_symlink")
    return df.agg(_n(other).alias("others"), _sum("size", other).alias("other_bytes"))


def by_extension(df: DataFrame) -> DataFrame:
    return df.where("is_regular_file and ext is not null").groupBy(F.lower("ext").alias("ext")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("entries"))


def by_age(df: DataFrame, as_of_ns: int) -> DataFrame:
    return df.groupBy(fn.age_bucket("mtime_ns", as_of_ns).alias("bucket")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("entries"))


def by_size(df: DataFrame) -> DataFrame:
    return df.where("is_regular_file").groupBy(fn.size_bucket("size").alias("bucket")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("entries"))


def single_pass(df: DataFrame, as_of_ns: int, keys: list[str] | None = None, version: str = "copy_sequence") -> DataFrame:
    """Totals and all three distributions in one scan by grouping sets; with ``keys``, over the
    newest row of each."""
    regular = F.col("is_regular_file")
    e, a, b = F.when(regular, F.lower("ext")), fn.age_bucket("mtime_ns", as_of_ns), F.when(regular, fn.size_bucket("size"))
    rows = df.select("size", e.alias("e"), a.alias("a"), b.alias("s"), *(keys or []), *([version] if keys else []))
    if keys:
        rows = latest_by_key(rows, keys, version)
    rows = rows.select("size", "e", F.col("a").cast("string").alias("a"), F.col("s").cast("string").alias("s"))
    sets = rows.groupingSets([[], ["e"], ["a"], ["s"]], "e", "a", "s").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("entries"), F.grouping_id().alias("g"))
    part = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "extension").when(F.col("g") == 5, "age").otherwise("size")
    key = F.coalesce("e", "a", "s")
    return sets.select(part.alias("part"), F.when(F.col("g") == 7, "").otherwise(key).alias("key"), "bytes", "entries").where("key is not null and entries > 0")


def event_counts(events: DataFrame, since_us: int) -> DataFrame:
    return events.where(F.col("create_at") >= since_us).groupBy("op", "is_dir", "is_symlink").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"))


DELTA = {"new": ["new"], "changed": ["data_changed", "metadata_changed", "both_changed", "directory_marker_removed"], "deleted": ["deleted"], "renamed": ["rename", "renamed"]}


def delta_counts(events: DataFrame, op: str = "op", weight: str | None = None) -> DataFrame:
    """One row per kind of entry: counts and bytes of new, changed, deleted and renamed ones.
    ``weight`` is how often an event counts; 1 without it."""
    kind = F.when(F.col("is_dir"), "dirs").when(F.col("is_symlink"), "links").when(F.col("is_regular_file"), "files").otherwise("other")
    times = F.col(weight) if weight else F.lit(1)
    aggs = []
    for out, ops in DELTA.items():
        hit = F.col(op).isin(*ops)
        aggs += [F.coalesce(F.sum(F.when(hit, times)), F.lit(0)).cast("long").alias(f"{out}_count"), F.coalesce(F.sum(F.when(hit, times * F.col("size"))), F.lit(0)).cast("long").alias(f"{out}_bytes")]
    return events.groupBy(kind.alias("kind")).agg(*aggs)


ERROR_CLASSES = ("scan", "copy", "copy_acl", "copy_xattr", "delete", "rename", "symlink_op", "pack", "integrity_check")


def error_counts(errors: DataFrame, column: str = "event") -> DataFrame:
    """All nine classes and their total in one row."""
    return errors.agg(*[_n(F.col(column) == x).alias(x) for x in ERROR_CLASSES], F.count(F.lit(1)).alias("total"))


def report(df: DataFrame, as_of_ns: int) -> DataFrame:
    """Every size and age bucket, empty ones too, with shares and averages; zero-safe."""
    spark = df.sparkSession
    dims = [("size", k, x) for k, x in enumerate(fn.SIZE_LABELS)] + [("age", k, x) for k, x in enumerate(fn.AGE_LABELS)]
    dim = F.broadcast(spark.createDataFrame(dims, "part string, bucket int, label string"))
    facts = by_size(df).withColumn("part", F.lit("size")).unionByName(by_age(df, as_of_ns).withColumn("part", F.lit("age")))
    rows = dim.join(facts, ["part", "bucket"], "left").select("part", "bucket", "label", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("entries", F.lit(0)).alias("entries"))
    total = rows.groupBy("part").agg(F.sum("bytes").alias("_b"), F.sum("entries").alias("_n"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = rows.join(F.broadcast(total), "part")
    out = out.select("part", "bucket", "label", "bytes", "entries", F.round(safe(F.col("entries") * 100.0, F.col("_n")), 4).alias("count_pct"), F.round(safe(F.col("bytes") * 100.0, F.col("_b")), 4).alias("bytes_pct"), F.round(safe(F.col("bytes") * 1.0, F.col("entries")), 4).alias("avg_bytes"))
    # The job's averages: bytes a file, name length an entry, depth a directory.
    job = summary_counts(df).withColumn("_entries", F.col("dirs") + F.col("files") + F.col("links"))
    parts = [("file_size", "file_bytes", "files"), ("name_length", "total_name", "_entries"), ("directory_depth", "total_depth", "dirs")]
    made = F.explode(F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(x).alias("label"), F.coalesce(a, F.lit(0)).cast("long").alias("bytes"), F.col(n).alias("entries")) for i, (x, a, n) in enumerate(parts))))
    job = job.select(made.alias("m")).select(F.lit("average").alias("part"), "m.*").withColumns({"count_pct": F.lit(0.0), "bytes_pct": F.lit(0.0), "avg_bytes": F.round(safe(F.col("bytes") * 1.0, F.col("entries")), 4)})
    return out.unionByName(job)


KINDS = ("files", "dirs", "links")
COUNTERS = ("scanned", "filtered", "retained", "failed", "vanished")
AMOUNTS = ("pruned_directories", "truncated_directories", "regular_file_bytes", "unknown_file_sizes", "versions", "delete_markers", "all_versions_bytes")
OUTCOMES = ("complete", "interrupted", "unreadable")


def scan_counts(contributions: DataFrame, *by: str) -> DataFrame:
    """The latest contribution of each directory replaces its earlier ones; then totals, per job where
    ``by`` names it: counters by kind and over all kinds, amounts, and listings by their outcome."""
    # The newest sequence of each directory first: two numbers a row; whole contributions are sorted
    # only where they are their directory's newest.
    keys = [*by, "dir"]
    newest = contributions.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("seq").alias("_seq"))
    last = contributions.join(newest, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "seq")], "left_semi")
    last = latest_by_key(last, keys, "seq")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    kinds = [total(f"{c}_{k}").alias(f"{c}_{k}") for c in COUNTERS for k in KINDS]
    whole = [total(sum((F.col(f"{c}_{k}") for k in KINDS[1:]), F.col(f"{c}_{KINDS[0]}"))).alias(c) for c in COUNTERS]
    listings = [F.count_if(F.col("outcome") == x).alias(f"{x}_listings") for x in OUTCOMES]
    return last.groupBy(*by).agg(*kinds, *whole, *[total(x).alias(x) for x in AMOUNTS], *listings, F.count_if("vanished_listing").alias("vanished_listings"), F.count(F.lit(1)).alias("directories"))


def checkpoint_valid(contributions: DataFrame, snapshots: DataFrame, *by: str) -> DataFrame:
    """``snapshots`` (``by``, scanned_entries, filtered_entries, retained_entries, observed) with what is
    wrong in them, if anything: by kind, all that was scanned is filtered, retained, failed or
    vanished; a snapshot's own totals are those of its counters; what was observed is what it scanned."""
    counts = scan_counts(contributions, *by)
    accounted = lambda k: sum((F.col(f"{c}_{k}") for c in COUNTERS[2:]), F.col(f"{COUNTERS[1]}_{k}"))
    kinds = F.array(*(F.when(F.col(f"scanned_{k}") != accounted(k), f"kinds:{k}") for k in KINDS))
    own = F.array(*(F.when(F.col(f"{c}_entries") != F.coalesce(c, F.lit(0)), f"total:{c}") for c in COUNTERS[:3]), F.when(F.col("scanned_entries") != F.col("observed"), "observed"))
    rows = snapshots.join(counts, list(by), "left")
    return rows.withColumn("wrong", F.array_compact(F.concat(kinds, own))).select(*snapshots.columns, F.array_join("wrong", ",").alias("wrong"), (F.size("wrong") == 0).alias("valid"))


def history_inventory(versions: DataFrame, latest_only: bool = False) -> DataFrame:
    """Per key its logical entry: bytes of all versions (or the latest), and the size it is distributed
    by (the largest, or the latest).  An incomplete history has bytes but is not counted yet."""
    latest = F.max(F.when(F.col("is_latest"), F.col("size")))
    per = versions.groupBy("relative_path").agg(F.sum("size").alias("_all"), F.max("size").alias("_top"), latest.alias("_last"), F.count(F.lit(1)).alias("_n"), F.max("history_records").alias("_want"))
    used = (F.coalesce("_last", F.lit(0)), F.coalesce("_last", F.lit(0))) if latest_only else (F.col("_all"), F.col("_top"))
    return per.select("relative_path", used[0].cast("long").alias("bytes"), used[1].cast("long").alias("distribution_size"), F.col("_n").alias("records"), (F.col("_n") == F.col("_want")).cast("long").alias("entries"))


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """Counted entries and all bytes, by the size bucket that each key is distributed to."""
    return inventory.groupBy(fn.size_bucket("distribution_size").alias("bucket")).agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))


def merge_change(changes: DataFrame) -> DataFrame:
    """Version changes of a key folded: all alike, that kind; else both."""
    low, high = F.min("change"), F.max("change")
    return changes.groupBy("relative_path").agg(F.when(low == high, low).otherwise("both_changed").alias("change"))


def failed_entries(failures: DataFrame) -> DataFrame:
    """Several failures of a path count once; all reasons are kept."""
    return failures.groupBy("path").agg(F.count(F.lit(1)).alias("failures"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def key_owners(df: DataFrame) -> DataFrame:
    """Live aliases of each handle (hard links)."""
    return df.where("file_handle is not null").groupBy("file_handle").agg(F.count_distinct("relative_path", "version_id").alias("aliases"))


def top_extensions(df: DataFrame, n: int = 5) -> DataFrame:
    return by_extension(df).orderBy(F.desc("bytes"), "ext").limit(n)


def count_latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return latest_by_key(df, keys, version).agg(F.count(F.lit(1)).alias("rows"))


def archive_manifest(df: DataFrame, allowed: Callable[[Column], Column], extra_depth: int = 0, max_depth: int = 0) -> DataFrame:
    """Every packed file with the archive it goes to: that of its first date-named ancestor that passes
    ``allowed``, as many levels deeper.  Archives deeper than ``max_depth`` (0: unlimited) are not made."""
    from .filters import has_date

    parts = F.split("relative_path", "/")
    at = F.array_position(F.transform(fn.ancestors("relative_path"), lambda d: F.coalesce(has_date(fn.name(d)) & allowed(d), F.lit(False))), F.lit(True))
    units = df.where("is_regular_file").select("relative_path", "size", parts.alias("parts"), F.least(at + extra_depth, F.size(parts) - 1).cast("int").alias("unit_depth"), at.alias("at")).where("at > 0")
    units = units.where(F.col("unit_depth") <= max_depth) if max_depth else units
    unit = F.array_join(F.slice("parts", F.lit(1), F.col("unit_depth")), "/")
    inside = F.array_join(F.slice("parts", F.col("unit_depth") + 1, F.size("parts")), "/")
    return units.select(F.concat(unit, F.lit(".tar")).alias("tar_path"), F.col("relative_path").alias("entry_path"), inside.alias("member"), "size")


def archive_plan(manifest: DataFrame) -> DataFrame:
    """Archives with their entries and bytes; a manifest needs no join back, it is the plan's rows."""
    return manifest.groupBy("tar_path").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


def execution_pick(runs: DataFrame) -> DataFrame:
    """Per job the latest completed execution, else the earliest."""
    done = F.max_by(F.when(F.col("phase") == "completed", F.col("execution_id")), F.when(F.col("phase") == "completed", F.col("sequence")))
    return runs.groupBy("job_id").agg(F.coalesce(done, F.min_by("execution_id", "sequence")).alias("execution_id"))


REPORT_SCHEMA = "by_type array<struct<label:string,bytes:long,entries:long>>, by_size array<struct<label:string,bytes:long,entries:long>>, by_time array<struct<label:string,bytes:long,entries:long>>"


def report_charts(reports: DataFrame, column: str = "report") -> DataFrame:
    """Chart rows out of final reports' JSON."""
    parsed = reports.select("job_id", F.from_json(column, REPORT_SCHEMA).alias("r"))
    out = None
    for chart in ("by_type", "by_size", "by_time"):
        part = parsed.select("job_id", F.lit(chart.removeprefix("by_")).alias("chart"), F.explode(f"r.{chart}").alias("x")).select("job_id", "chart", "x.label", "x.bytes", "x.entries")
        out = part if out is None else out.unionByName(part)
    return out


def report_json(df: DataFrame, as_of_ns: int) -> DataFrame:
    """A job's final report as JSON, the shape ``report_charts`` reads."""

    def part(rows: DataFrame, key: str, name: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("label"), "bytes", "entries")))
        return rows.groupBy("job_id").agg(listed.alias(name))

    regular = df.where("is_regular_file")
    agg = lambda d, k: d.groupBy("job_id", k.alias("label")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("entries"))
    a = part(agg(regular.where("ext is not null"), F.lower("ext")), "label", "by_type")
    b = part(agg(regular, fn.size_bucket("size")), "label", "by_size")
    t = part(agg(df, fn.age_bucket("mtime_ns", as_of_ns)), "label", "by_time")
    return a.join(b, "job_id", "full").join(t, "job_id", "full").select("job_id", F.to_json(F.struct("by_type", "by_size", "by_time")).alias("report"))
