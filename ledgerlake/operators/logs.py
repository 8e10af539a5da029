"""Queries over job logs whose records carry spans (name, job, worker, path)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import settle
from ..shipping import ship

LOG_SCHEMA = "timestamp string, level string, fields struct<message:string>, target string, filename string, line_number long, spans array<struct<name:string,job_id:string,src:string,dest:string,recv_id:long,path:string>>"


def by_path(logs: DataFrame, path: str) -> DataFrame:
    return logs.where(F.exists("spans", lambda s: s["path"] == path))


def by_job(logs: DataFrame, job_id: str) -> DataFrame:
    return logs.where(F.exists("spans", lambda s: s["job_id"] == job_id))


def errors(logs: DataFrame) -> DataFrame:
    return logs.where("level = 'ERROR'")


def errors_per_worker(logs: DataFrame) -> DataFrame:
    return errors(logs).select(F.explode("spans").alias("s")).where("s.recv_id is not null").groupBy(F.col("s.recv_id").alias("recv_id")).agg(F.count(F.lit(1)).alias("errors"))


def worker_paths(logs: DataFrame, recv_id: int) -> DataFrame:
    return logs.select(F.explode(F.filter("spans", lambda s: s["recv_id"] == recv_id)).alias("s")).select("s.path").where("path is not null").distinct()


def failed_paths(logs: DataFrame) -> DataFrame:
    return errors(logs).select(F.explode("spans").alias("s")).select("s.path").where("path is not null").distinct()


def errors_between(logs: DataFrame, start_us: int, stop_us: int) -> DataFrame:
    return errors(logs).where((F.col("at_us") >= start_us) & (F.col("at_us") < stop_us))


def text_failed(lines: DataFrame, column: str = "message") -> DataFrame:
    """Lines that report a failed path, with it."""
    pattern = r'(?:CopyEntry )?failed "([^"]+)"'
    return lines.where(F.col(column).rlike(pattern)).withColumn("failed_path", F.regexp_extract(column, pattern, 1))


PATTERN_BYTES, GRAM, FILTER_BITS = 1 << 20, 6, 1 << 25
"""Patterns of more bytes are matched by their rarest grams of at most so many characters, which a
filter of so many bits lets through."""


def _automaton_matches(patterns):
    """Every pattern inside each text, found in one walk over its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, pattern in enumerate(patterns.value):
            machine.add_word(pattern, k)
        machine.make_automaton()
        every = pa.array(patterns.value, pa.string())
        for batch in batches:
            found = [sorted({k for _, k in machine.iter(text)}) if text else [] for text in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            which = pa.array([k for f in found for k in f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), every.take(which)], ["id", "pattern"])

    return run


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern) for every ``texts`` (id, text) that contains a pattern (pattern), once each.

    Patterns whose counted size is at most ``PATTERN_BYTES`` are one Aho-Corasick automaton, sent to
    every task.  More of them are joined: each on that one of its grams which the fewest texts have,
    then verified; a pattern with a gram that no text has meets nothing.  Grams of texts that no
    pattern has, and then those on which none is joined, are kept out of the shuffles by ``_among``."""
    patterns = settle(patterns.select("pattern").where("pattern <> ''").distinct())
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("n")).head()["n"]
    if size <= PATTERN_BYTES:
        words = texts.sparkSession.sparkContext.broadcast([r["pattern"] for r in patterns.collect()])
        if not words.value:
            return texts.select("id").join(patterns.limit(0))
        ship(texts.sparkSession)
        return texts.select("id", "text").mapInArrow(_automaton_matches(words), f"id {texts.schema['id'].dataType.simpleString()}, pattern string")
    width = F.least(F.length("pattern"), F.lit(GRAM))
    widths = [r["q"] for r in patterns.select(width.alias("q")).distinct().collect()]  # GRAM at most
    cut = lambda text, q: F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(F.col(text), i, q))).otherwise(F.array().cast("array<string>"))
    own = patterns.select("pattern", F.explode(F.array_distinct(F.flatten(F.array(*(F.when(width == q, cut("pattern", q)).otherwise(F.array().cast("array<string>")) for q in widths))))).alias("gram"))
    grams = texts.select("id", F.explode(F.array_distinct(F.flatten(F.array(*(cut("text", q) for q in widths))))).alias("gram"))
    grams = settle(_among(grams, own, "gram"))
    rare = own.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rare = rare.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("pattern", "r.gram")
    rare = settle(rare)
    return _among(grams, rare, "gram").join(rare, "gram").select("id", "pattern").distinct().join(texts, "id").where(F.contains("text", "pattern")).select("id", "pattern").distinct()


def _among(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """All rows whose ``column`` is one of ``wanted``'s, and few others: one bit of ``FILTER_BITS`` for
    each hash.  The bits are a broadcast table of 64 a row, whatever the number of values."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    word, mask = F.shiftright("_bit", 6), F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    bits = wanted.select(bit.alias("_bit")).groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    return rows.withColumn("_bit", bit).withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(mask) != 0).select(*rows.columns)


def trace_chain(logs: DataFrame, margin_us: int = 60_000_000) -> DataFrame:
    """Records whose span path is one that failed, or whose message contains one (``trace``); for a
    failed path that no other record traces, those within ``margin_us`` of its error (``window``).

    Lines are numbered (``line``).  Spans meet the failed paths in an equi join, messages as
    ``containing`` says; windows meet the lines of their slots, as ``_around`` says."""
    failed = errors(logs).select("at_us", F.explode(F.concat("spans.path", F.array(F.regexp_extract("message", r'failed "([^"]+)"', 1)))).alias("error_path")).where("error_path <> ''")
    failed = settle(failed.distinct())
    bad = failed.select("error_path").distinct()
    by_span = logs.select("line", F.explode(F.array_distinct("spans.path")).alias("error_path")).join(bad, "error_path", "left_semi").select("line", "error_path")
    by_text = containing(logs.select(F.col("line").alias("id"), F.col("message").alias("text")), bad.select(F.col("error_path").alias("pattern"))).toDF("line", "error_path")
    found = settle(by_span.union(by_text).distinct())
    traced = found.join(logs.where("level <> 'ERROR'").select("line"), "line", "left_semi").select("error_path").distinct()
    windows = settle(_windows(failed.join(traced, "error_path", "left_anti"), margin_us))
    repeated = settle(logs.groupBy("line").count().where("count > 1").select("line"))
    if repeated.isEmpty():
        around = _around(logs, windows, margin_us)
    else:  # several rows of one number are one line
        again = _around(logs.join(repeated, "line", "left_semi"), windows, margin_us).distinct().join(found, ["line", "error_path"], "left_anti")
        around = _around(logs.join(repeated, "line", "left_anti"), windows, margin_us).unionByName(again)
    return found.select("line", "error_path", F.lit("trace").alias("why")).unionByName(around.select("line", "error_path", F.lit("window").alias("why")))


def _slot(margin_us: int) -> Column:
    """Slots are as long as a window."""
    width = max(2 * margin_us, 1)
    return F.expr(f"(at_us - pmod(at_us, {width}L)) div {width}L")


def _windows(failed: DataFrame, margin_us: int) -> DataFrame:
    """(error_path, slot, until, a, z, since): the times of a slot within ``margin_us`` of an error.

    Errors of one slot are no further apart than a window is long, so their windows are one range,
    from the first to the last (``a`` to ``z``).  The slot after it is covered to that range's end
    (``until``), the one before it from its begin (``since``), and no other is reached."""
    per = failed.groupBy("error_path", _slot(margin_us).alias("slot")).agg((F.min("at_us") - margin_us).alias("a"), (F.max("at_us") + margin_us).alias("z"))
    none = F.lit(None).cast("long")
    row = lambda step, until, a, z, since: F.struct((F.col("slot") + step).alias("slot"), until.alias("until"), a.alias("a"), z.alias("z"), since.alias("since"))
    a, z = F.col("a"), F.col("z")
    parts = per.select("error_path", F.explode(F.array(row(-1, none, none, none, a), row(0, none, a, z, none), row(1, z, none, none, none))).alias("p")).select("error_path", "p.*")
    return parts.groupBy("error_path", "slot").agg(*(F.max(x).alias(x) for x in ("until", "a", "z", "since")))


def _around(logs: DataFrame, windows: DataFrame, margin_us: int) -> DataFrame:
    """(line, error_path) of lines inside the ``windows`` of paths which no line but errors traces,
    without the lines that trace the path themselves.

    A line lies in one slot and meets a path there once, and whether it traces the path its own
    spans and message say, which only errors need: the pairs, whose number grows with the square of
    the lines a minute, are filtered where they arise and never shuffled."""
    error = ~F.coalesce(F.col("level") != "ERROR", F.lit(False))
    lines = logs.select("line", "at_us", _slot(margin_us).alias("slot"), F.when(error, F.col("spans.path")).alias("_paths"), F.when(error, F.col("message")).alias("_message"))
    inside = (F.col("at_us") <= F.col("until")) | F.col("at_us").between(F.col("a"), F.col("z")) | (F.col("at_us") >= F.col("since"))
    own = F.coalesce(F.array_contains("_paths", F.col("error_path")), F.lit(False)) | F.coalesce(F.contains("_message", "error_path"), F.lit(False))
    return lines.join(windows, "slot").where(inside & ~own).select("line", "error_path")
