"""Latest-row, first-row and conflict rules over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], *version: str | Column) -> DataFrame:
    """The row with the newest version per key: a partial aggregation (by sort, as rows hold strings).

    Further version columns break ties, so the result does not depend on row order."""
    rest = [x for x in df.columns if x not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*df.columns)


def with_tombstones(df: DataFrame, tombstones: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows not hidden by a newer tombstone of their key."""
    rows = df.withColumn("is_deleted", F.lit(False)).unionByName(tombstones.withColumn("is_deleted", F.lit(True)), allowMissingColumns=True)
    return latest_by_key(rows, keys, version, "is_deleted").where("not is_deleted").drop("is_deleted")


def limit_by(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows per key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def conflicts(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Keys with their class if all rows agree, else ``conflict``."""
    low, high = F.min(what), F.max(what)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.when(low == high, low).otherwise("conflict").alias("result"))


def latest_versions(df: DataFrame) -> DataFrame:
    """Only each key's latest version, under a blank version."""
    return df.where("is_latest").withColumn("version_id", F.lit(""))


def dedup_first(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union in which the first part that has a key wins."""
    tagged = [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return limit_by(out, keys, ["_p", *order]).drop("_p")
