"""Directory trees: direct children of a prefix, all directories at once, top-n with a rest row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fn


def _normal(df: DataFrame) -> DataFrame:
    """Files and directories only; an unobserved size counts as 0 and has no time."""
    rows = df.where(F.col("entry_kind").isin("file", "directory"))
    seen = F.col("size_observed")
    return rows.select("relative_path", "entry_kind", F.when(seen & (F.col("entry_kind") == "file"), F.col("size")).otherwise(0).alias("size"), F.when(seen, F.col("mtime_ns")).alias("mtime_ns"))


def children(df: DataFrame, prefix: str = "") -> DataFrame:
    """Direct children of a prefix with bytes, files, directories and newest time below them."""
    p = prefix + "/" if prefix and not prefix.endswith("/") else prefix
    rows = _normal(df).where(F.col("relative_path").startswith(p) & (F.length("relative_path") > len(p)))
    rest = F.substring("relative_path", len(p) + 1, 1 << 30)
    rows = rows.withColumn("name", F.split(rest, "/")[0]).withColumn("deeper", rest.contains("/"))
    is_file = F.col("entry_kind") == "file"
    grouped = rows.groupBy("name").agg(
        F.sum("size").cast("long").alias("bytes"), F.count_if(is_file).alias("file_count"), F.count_if(~is_file & F.col("deeper")).alias("directory_count"), F.max("mtime_ns").alias("mtime_ns"),
        F.max((F.col("deeper") | ~is_file).cast("int")).alias("_d"),
    )
    return grouped.select(F.concat(F.lit(p), F.col("name")).alias("path"), F.when(F.col("_d") == 1, "directory").otherwise("file").alias("kind"), "bytes", "file_count", "directory_count", "mtime_ns")


def all_directories(df: DataFrame) -> DataFrame:
    """Every directory's totals in one job: files are added up per parent first, and only
    directories are multiplied by their depth."""
    per = _normal(df).where("entry_kind = 'file'").groupBy(fn.parent("relative_path").alias("dir")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("mtime_ns").alias("t"))
    up = F.array_append(F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.array_append(fn.ancestors("dir"), F.col("dir"))), F.lit(""))
    return per.select(F.explode(up).alias("path"), "b", "n", "t").groupBy("path").agg(F.sum("b").cast("long").alias("bytes"), F.sum("n").alias("file_count"), F.max("t").alias("mtime_ns"))


def top_with_other(rows: DataFrame, n: int, metric: str = "bytes") -> DataFrame:
    """Ranks 1 to n, the rest merged into one row that conserves the totals.

    The n first come from a distributed top-n; the rest is an anti join and an aggregate."""
    top = rows.orderBy(F.desc(metric), "path", "kind").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "path", "kind")).cast("long"))
    rest = rows.join(top.select("path", "kind"), ["path", "kind"], "left_anti").agg(F.sum("bytes").alias("bytes"), F.sum("file_count").alias("file_count"), F.sum("directory_count").alias("directory_count"), F.count(F.lit(1)).alias("_n"))
    other = rest.where("_n > 0").select(F.lit("").alias("path"), F.lit("other").alias("kind"), "bytes", "file_count", "directory_count", F.lit(n + 1).cast("long").alias("rank"))
    return ranked.select(*other.columns).unionByName(other)


def totals_partial(level: DataFrame, expected_files: DataFrame) -> DataFrame:
    """Totals of a level and whether it is partial: not completed, errors, or other file counts."""
    total = level.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("file_count"))
    odd = ~F.col("completed") | (F.col("errors") > 0) | (F.col("file_count") != F.col("expected"))
    return total.join(expected_files).select("bytes", "file_count", odd.alias("is_partial"))
