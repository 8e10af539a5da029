"""Reading listings, catalogues, file lists and logs; publishing catalogues, events and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as fn
from ..operators.logs import LOG_SCHEMA

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("relative_path", T.StringType()), T.StructField("version_id", T.StringType()), T.StructField("size", T.LongType()), T.StructField("ext", T.StringType()),
    T.StructField("mtime_ns", T.LongType()), T.StructField("mode", T.LongType()), T.StructField("uid", T.LongType()), T.StructField("file_handle", T.StringType()),
    T.StructField("entry_kind", T.StringType()), T.StructField("size_observed", T.BooleanType()), T.StructField("is_dir", T.BooleanType()), T.StructField("is_symlink", T.BooleanType()),
    T.StructField("storage_type", T.StringType()), T.StructField("confirmed", T.BooleanType()), T.StructField("generation", T.LongType()), T.StructField("job_id", T.LongType()),
])


def neutral(df: DataFrame) -> DataFrame:
    """The fixed schema; columns an older layout lacks are derived from its flags or are neutral."""
    derived = {
        "entry_kind": F.when(F.col("is_dir"), "directory").when(F.col("is_symlink"), "symlink").otherwise("file"),
        "size_observed": F.lit(True), "version_id": F.lit(""), "confirmed": F.lit(True), "generation": F.lit(0), "storage_type": F.lit("nas"),
    }
    cols = []
    for f in CATALOGUE_SCHEMA.fields:
        value = F.col(f.name) if f.name in df.columns else derived.get(f.name, F.lit(None))
        cols.append((F.coalesce(value, derived[f.name]) if f.name in df.columns and f.name in ("entry_kind", "size_observed") else value).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_catalogue(spark: SparkSession, path: str, job_id: int | None = None) -> DataFrame:
    """A published catalogue; the job filter prunes partitions."""
    df = spark.read.parquet(path)
    return neutral(df.where(F.col("job_id") == job_id) if job_id is not None else df)


def listing(raw: DataFrame, scheme: str = "nas") -> DataFrame:
    """Catalogue rows from a raw listing (path, size, mtime_ns, is_dir, is_symlink)."""
    path = F.when(F.lit(scheme) == "s3", F.col("path")).otherwise(F.translate("path", "\\", "/"))
    clean = F.regexp_replace(path, "^/+|/+$", "")
    kind = F.when(F.col("is_dir"), "directory").when(F.col("is_symlink"), "symlink").otherwise("file")
    return raw.select(clean.alias("relative_path"), F.lit("").alias("version_id"), fn.name(clean).alias("name"), F.when(~F.col("is_dir"), fn.ext(clean)).alias("ext"), "size", "mtime_ns", "is_dir", "is_symlink", (~F.col("is_dir") & ~F.col("is_symlink")).alias("is_regular_file"), kind.alias("entry_kind"), F.lit(scheme).alias("storage_type"))


def list_directory(spark: SparkSession, root: str) -> DataFrame:
    """A real directory's files, listed in parallel; their content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listing(files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink")))


def file_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """A file list's paths: trimmed, without blanks and comments; absolute paths and ``..`` are rejected."""
    path = F.trim(F.col(column))
    return lines.select(path.alias("relative_path")).where((F.col("relative_path") != "") & ~F.col("relative_path").startswith("#") & ~F.col("relative_path").startswith("/") & ~F.col("relative_path").rlike(r"(^|/)\.\.(/|$)"))


def select_listed(df: DataFrame, paths: DataFrame) -> DataFrame:
    return df.join(paths.select("relative_path"), "relative_path", "left_semi")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files (file, line, value), each with its number in its file from 1.

    Files are read in splits, in parallel.  A split's lines follow on in one partition, so a line's
    number is its distance from the split's first line plus the lines of the file's splits before it
    (counted per split, a row each); no line is shuffled for it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_split", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(splits, ["file", "_split"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def _place(lines: DataFrame) -> list[str]:
    """Where a line comes from, if it is known; (file, time, line) is the order of a log."""
    return [c for c in ("file", "line") if c in lines.columns]


def parse_log_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Structured records of a JSON log, with file and line where ``lines`` has them; lines that are
    no JSON are dropped."""
    at = _place(lines)
    parsed = lines.select(*at, F.from_json(column, LOG_SCHEMA).alias("r")).where("r.timestamp is not null")
    return parsed.select(*at, F.unix_micros(F.try_to_timestamp("r.timestamp")).alias("at_us"), "r.level", F.col("r.fields.message").alias("message"), "r.target", "r.spans")


def parse_log_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Time, level and message of text log lines, with file and line where ``lines`` has them."""
    pattern = r"^(\S+)\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(.*)$"
    rows = lines.where(F.col(column).rlike(pattern))
    part = lambda k: F.regexp_extract(column, pattern, k)
    return rows.select(*_place(lines), F.unix_micros(F.try_to_timestamp(part(1))).alias("at_us"), part(2).alias("level"), part(3).alias("message")).where("at_us is not null")


def publish(df: DataFrame, path: str) -> None:
    """Replace the snapshots of the jobs in ``df``; other jobs' partitions stay as they are."""
    df.repartition("job_id", F.pmod(F.xxhash64("relative_path"), F.lit(8))).sortWithinPartitions("relative_path").write.partitionBy("job_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _dropped(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_job(spark: SparkSession, tables: list[str], job_id: int) -> int:
    """Drop one job's partition of every shared table; the files of other jobs are not touched.
    Returns how many tables had it, so a repeated call returns 0."""
    return sum(_dropped(spark, f"{table}/job_id={job_id}") for table in tables)


def new_events(existing: DataFrame, incoming: DataFrame, buckets: int = 256) -> DataFrame:
    """Events to append: keys of the round that exist keep theirs; new keys get the numbers after
    its last, without gaps.  Of several incoming rows of a key the smallest is taken.

    Numbers are those of the buckets of a round's events before a row's own (a row a bucket), plus
    its place in the bucket, so no task holds a round or a path."""
    key = ["round", "op", "path", "version_id"]
    rest = [x for x in incoming.columns if x not in key]
    one = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(*incoming.columns)
    here = existing.join(one.select("round").distinct(), "round", "left_semi")
    fresh = one.join(here.select(*key), key, "left_anti").withColumn("_b", F.pmod(F.xxhash64("path", "op", "version_id"), F.lit(buckets)))
    last = here.groupBy("round").agg(F.max("create_at").alias("_last"))
    counts = fresh.groupBy("round", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("round", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("round").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("round", "_b").orderBy("path", "op", "version_id"))
    numbered = fresh.withColumn("_p", place).join(before, ["round", "_b"]).join(last, "round", "left")
    return numbered.withColumn("create_at", (F.coalesce("_last", F.lit(0)) + F.col("_before") + F.col("_p")).cast("long")).select(*incoming.columns)


def append_events(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Idempotent under replay: a second append of the same events adds nothing."""
    try:
        existing = spark.read.schema(incoming.schema).parquet(path)
    except Exception as error:  # the table's first write
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing = incoming.limit(0)
    new_events(existing, incoming).write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, root: str, snapshot: str) -> None:
    """A round's rows as new files, below a folder of their own: nobody reads them before they are
    committed, and nothing that is read is changed."""
    part = F.pmod(F.xxhash64("relative_path"), F.lit(8))
    df.repartition("job_id", part).sortWithinPartitions("relative_path").write.partitionBy("job_id").mode("overwrite").parquet(f"{root}/rows/snapshot={snapshot}")


def _known_runs(spark: SparkSession, root: str) -> DataFrame:
    schema = "job_id long, sequence long, snapshot string"
    try:
        return spark.read.schema(schema).parquet(f"{root}/runs")
    except Exception as error:  # the table's first write
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def commit_round(df: DataFrame, root: str, snapshot: str, sequence: int) -> None:
    """Write a round's jobs as a snapshot, then the run rows that name it: the commit pointer.

    A crash before the run rows, however many of its partitions are written, leaves readers on the
    jobs' last committed snapshots; a replay writes its own folder again and records a run once."""
    spark = df.sparkSession
    write_snapshot(df, root, snapshot)
    done = spark.read.parquet(f"{root}/rows/snapshot={snapshot}").select(F.col("job_id").cast("long").alias("job_id")).distinct()
    runs = done.select("job_id", F.lit(sequence).cast("long").alias("sequence"), F.lit(snapshot).alias("snapshot"))
    runs.join(_known_runs(spark, root).select("job_id", "sequence"), ["job_id", "sequence"], "left_anti").coalesce(1).write.mode("append").parquet(f"{root}/runs")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Each job's rows of its newest committed run; the pointers prune the snapshots' partitions."""
    newest = _known_runs(spark, root).groupBy("job_id").agg(F.max_by("snapshot", "sequence").alias("snapshot"))
    rows = spark.read.parquet(f"{root}/rows").withColumns({"job_id": F.col("job_id").cast("long"), "snapshot": F.col("snapshot").cast("string")})
    return rows.join(newest, ["snapshot", "job_id"]).drop("snapshot")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the snapshots that no job's ``keep`` newest runs name; returns how many."""
    runs = _known_runs(spark, root).withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("sequence"))))
    held = {r["snapshot"] for r in runs.where(F.col("_n") <= keep).select("snapshot").distinct().collect()}  # names of snapshots
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/rows")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName().removeprefix("snapshot=") for f in found if f.getPath().getName().startswith("snapshot=")]
    return sum(_dropped(spark, f"{root}/rows/snapshot={n}") for n in names if n not in held)


def manifest(df: DataFrame) -> DataFrame:
    """Archive manifest rows: archive, entry, kind, size."""
    return df.select(F.concat(fn.parent("relative_path"), F.lit(".tar")).alias("tar_path"), F.col("relative_path").alias("entry_path"), "entry_kind", "size", "mtime_ns")
