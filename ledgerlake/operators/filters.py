"""Filters over catalogue entries: structured conditions, globs and subtree rules."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn

_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_TYPES = {"file": "is_regular_file", "dir": "is_dir", "symlink": "is_symlink"}


@dataclass(frozen=True)
class Condition:
    """One condition; incomplete ones (no operator or value) are ignored."""

    field: str
    op: str | None = None
    value: str | float | None = None


def condition(what: Condition, as_of_ns: int) -> Column:
    """A condition as a predicate; globs and literals are checked here, on the driver."""
    f, op, value = what.field, what.op, what.value
    if f == "type":
        flag = F.col(_TYPES[str(value)])
        return flag if op == "==" else ~flag
    if f == "size":
        if op == "!=":
            raise ValueError("size has no !=")
        return _OPS[op](F.col("size"), F.lit(int(value)))
    if f == "modified":
        text = str(value)
        if text.removesuffix("d").replace(".", "", 1).isdigit():
            # Age in days before the fixed clock: younger than d means later than its moment.
            moment = F.lit(as_of_ns - int(float(text.removesuffix("d")) * fn.DAY_NS))
            return {"<": operator.gt, ">": operator.lt, "<=": operator.ge, ">=": operator.le, "==": operator.eq}[op](F.col("mtime_ns"), moment)
        return _OPS[op](F.col("mtime_ns"), F.unix_micros(F.to_timestamp(F.lit(text))) * 1000)
    if f == "name":
        hit = fn.name("relative_path").rlike(fn.glob_to_regex(str(value)))
        return hit if op == "==" else ~hit
    if f == "path":
        hit = F.col("relative_path").rlike(fn.glob_to_regex(str(value), whole_path=True))
        return hit if op == "==" else ~hit
    if f == "extension":
        hit = F.coalesce(F.lower("ext") == str(value).lower(), F.lit(False))
        return hit if op == "==" else ~hit
    if f == "regex":
        hit = F.col("relative_path").rlike(str(value))
        return hit if op == "=~" else ~hit
    if f == "dir_date":
        return has_date(fn.name(fn.parent("relative_path")))
    raise ValueError(f"unknown field {f}")


def by_groups(df: DataFrame, groups: Iterable[Iterable[Condition]], as_of_ns: int) -> DataFrame:
    """OR of groups, AND inside a group; incomplete conditions and empty groups do not count."""
    parts = []
    for group in groups:
        complete = [condition(x, as_of_ns) for x in group if x.field == "dir_date" or x.op and x.value not in (None, "")]
        if complete:
            parts.append(reduce(operator.and_, complete))
    return df.where(reduce(operator.or_, parts)) if parts else df


def has_date(segment: Column) -> Column:
    """A valid YYYY-MM-DD, YYYYMMDD or yymmdd at any offset."""
    n = F.length(segment)
    starts = F.when(n > 5, F.sequence(F.lit(1), n - 5)).otherwise(F.array().cast("array<int>"))

    def date_at(i: Column) -> Column:
        a, b, s = F.substring(segment, i, F.lit(10)), F.substring(segment, i, F.lit(8)), F.substring(segment, i, F.lit(6))
        long_ = a.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(a, F.lit("yyyy-MM-dd")).isNotNull()
        mid = b.rlike(r"^\d{8}$") & F.try_to_timestamp(b, F.lit("yyyyMMdd")).isNotNull()
        short = s.rlike(r"^\d{6}$") & F.try_to_timestamp(F.concat(F.lit("20"), s), F.lit("yyyyMMdd")).isNotNull()
        return F.coalesce(long_, F.lit(False)) | F.coalesce(mid, F.lit(False)) | F.coalesce(short, F.lit(False))

    return F.coalesce(F.exists(starts, date_at), F.lit(False))


def _under(df: DataFrame, directories: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with entries that have one of the directories above them."""
    above = df.select("relative_path", F.explode(fn.ancestors("relative_path")).alias("dir"))
    below = above.join(directories.select(F.col("relative_path").alias("dir")), "dir", "left_semi").select("relative_path").distinct()
    return df.join(below, "relative_path", how)


def match_subtree(df: DataFrame, matched: Column) -> DataFrame:
    """Entries that match, or lie under a directory that matched in full."""
    flagged = df.withColumn("_m", F.coalesce(matched, F.lit(False)))
    under = _under(flagged.where("not _m"), flagged.where("_m and is_dir"), "left_semi")
    return flagged.where("_m").unionByName(under).drop("_m")


def exclude_subtree(df: DataFrame, full: Column, partial: Column | None = None) -> DataFrame:
    """A full match drops the entry and all under it; a partial match drops the entry only."""
    flagged = df.withColumn("_m", F.coalesce(full, F.lit(False))).withColumn("_p", F.coalesce(partial, F.lit(False)) if partial is not None else F.lit(False))
    return _under(flagged.where("not _m and not _p"), flagged.where("_m"), "left_anti").drop("_m", "_p")


def to_depth(df: DataFrame, most: int) -> DataFrame:
    """Entries of at most ``most`` path components; 0 is unlimited."""
    return df.where(fn.depth("relative_path") <= most) if most else df


def catalogue(df: DataFrame, is_dir: bool | None = None, is_symlink: bool | None = None, suffix: str | None = None, confirmed_only: bool = True) -> DataFrame:
    """The catalogue query: flags, extension suffix (any case), confirmed rows."""
    if is_dir is not None:
        df = df.where(F.col("is_dir") == is_dir)
    if is_symlink is not None:
        df = df.where(F.col("is_symlink") == is_symlink)
    if suffix:
        df = df.where(F.lower("relative_path").endswith(suffix.lower()))
    return df.where("confirmed") if confirmed_only else df


def scope(df: DataFrame, job_id: int, generation: int | None = None, live: bool = True) -> DataFrame:
    df = df.where(F.col("job_id") == job_id)
    df = df.where(F.col("generation") == generation) if generation is not None else df
    return df.where("not is_deleted") if live else df


def acl_owner(df: DataFrame, text: str, inherited_too: bool = False) -> DataFrame:
    """Matching ACEs per entry: trustee contains the text, explicit unless asked otherwise; entries
    with nothing explicit while inheritance is on are dropped."""
    hit = lambda a: a["trustee"].contains(text) & (F.lit(inherited_too) | ~a["inherited"])
    explicit = F.exists("aces", lambda a: ~a["inherited"])
    found = df.withColumn("aces", F.filter("aces", hit)).withColumn("_e", explicit)
    return found.where(F.col("_e") | ~F.col("inheritance")).where(F.size("aces") > 0).drop("_e")


SUMMARY_COLUMNS = (
    "relative_path", "version_id", "size", "ext", "mtime_ns", "mode", "uid", "gid", "is_dir", "is_symlink", "is_regular_file", "entry_kind",
    "file_handle", "marker_state", "metadata_digest", "identity_key", "source_version_id", "confirmed", "copy_path_confirmed", "copy_data_confirmed", "generation", "copy_sequence",
)


def summary(df: DataFrame, prefix: str = "") -> DataFrame:
    """The comparison and statistics projection, with prefixed names on request."""
    return df.select(*[F.col(x).alias(prefix + x) for x in SUMMARY_COLUMNS])


def normalised_path(path: str = "relative_path", storage: str = "storage_type") -> Column:
    """Backslashes are separators everywhere but in object stores."""
    return F.when(F.col(storage) == "s3", F.col(path)).otherwise(F.translate(path, "\\", "/"))


def safe_tree_path(path: str, limit: int = 120) -> tuple[str, int]:
    """A checked tree path without its trailing slash, and a checked limit."""
    if len(path.encode()) > 4096 or path.startswith("/") or any(ord(x) < 32 or 127 <= ord(x) < 160 for x in path) or not 1 <= limit <= 500:
        raise ValueError("invalid tree request")
    clean = path.removesuffix("/")
    if clean and any(s in ("", ".", "..") for s in clean.split("/")):
        raise ValueError("invalid tree path")
    return clean, limit


def safe_path_column(path: str = "relative_path") -> Column:
    """The same rule as a column, for auditing paths in bulk."""
    p = F.col(path)
    parts = F.split(F.regexp_replace(p, "/$", ""), "/")
    bad = F.exists(parts, lambda s: s.isin(".", "..") | ((s == "") & (F.length(p) > 0)))
    return (F.octet_length(p) <= 4096) & ~p.startswith("/") & ~p.rlike(r"[\x00-\x1F\x7F-\x9F]") & ~bad
