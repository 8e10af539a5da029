"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..shared import root
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(ship(spark).conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; see ``shared.root``."""
    return root(spark)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ship(df.sparkSession)
    return shared.settle(df)


def carried(df: DataFrame, *used: str) -> Column:
    """All other columns of the input in one struct, out of reach of clashing names."""
    ship(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return F.struct(*rest) if rest else F.struct(F.lit(None).cast("boolean").alias("_"))


def restored(df: DataFrame, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """``columns`` of a frame with a struct ``rest``; those in ``made`` replace or follow them."""
    inside = {f.name for f in df.schema["rest"].dataType}
    kept = [made[c].alias(c) if c in made else F.col(f"rest.`{c}`") for c in columns if c in made or c in inside]
    return df.select(*kept, *[v.alias(k) for k, v in made.items() if k not in columns])
