"""Streaming pipelines; each runs to the end of its input with ``availableNow``.

Results are written to Parquet in the shared folder by ``foreachBatch``, one
folder per batch id and overwritten on replay, so a batch that runs twice after
a crash is in the result once."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.compare import final_renames, scan_compare
from ..operators.dedup import latest_by_key
from ..shipping import ship
from ..sources.io import new_events


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A Parquet table as a stream, with the schema of its batch reading."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, batch: Callable[[DataFrame, int], None], where: str, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{where}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def collected(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """All batches of a stream as one DataFrame, with the batch id."""
    run_to_end(stream, lambda df, b: df.write.mode("overwrite").parquet(f"{where}/rows/batch={b}"), where, mode)
    return stream.sparkSession.read.parquet(f"{where}/rows")


def compare_stream(stage: DataFrame, base: DataFrame, where: str) -> DataFrame:
    """Each batch is diffed against the static baseline; events are written before the new base rows.

    A batch is read once and not kept in memory: its rows are in its events (once for each row that
    the baseline has of their key), from where the base rows are taken."""

    def batch(df: DataFrame, b: int) -> None:
        events = f"{where}/events/batch={b}"
        scan_compare(df, base).write.mode("overwrite").parquet(events)
        df.sparkSession.read.parquet(events).select(*df.columns).write.mode("overwrite").parquet(f"{where}/base/batch={b}")

    run_to_end(stage, batch, where)
    return stage.sparkSession.read.parquet(f"{where}/events").drop("batch")


def finalize(stage: DataFrame, base: DataFrame, where: str) -> DataFrame:
    """A round to its end, then renames and deletions over the whole of it."""
    compare_stream(stage, base, where)
    live = stage.sparkSession.read.parquet(f"{where}/base").drop("batch")
    return final_renames(base, live)


def _marker(spark: SparkSession, file: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exactly_once(stream: DataFrame, where: str, at: Callable[[str, int], None] = lambda place, batch: None) -> DataFrame:
    """Events numbered and written once, whatever dies between sink, ledger and checkpoint.

    A batch writes a folder of its own, then its mark in the ledger; Spark's checkpoint follows.  A
    batch that comes again before its mark writes the same folder again, from the same earlier
    batches and so with the same numbers; one that has its mark is passed over.  Readers see marked
    batches only.  ``at`` is told each place that is reached (``begun``, ``written``, ``recorded``)."""
    spark = stream.sparkSession

    def batch(df: DataFrame, b: int) -> None:
        files, mark = _marker(spark, f"{where}/ledger/{b}")
        if files.exists(mark):
            return
        at("begun", b)
        earlier = recorded_events(spark, where, b)
        new_events(df.limit(0) if earlier is None else earlier, df).write.mode("overwrite").parquet(f"{where}/events/batch={b}")
        at("written", b)
        files.create(mark).close()
        at("recorded", b)

    run_to_end(stream, batch, where)
    return recorded_events(spark, where)


def recorded_events(spark: SparkSession, where: str, before: int | None = None) -> DataFrame | None:
    """Events of the batches in the ledger, of those before a batch where one is named."""
    files, ledger = _marker(spark, f"{where}/ledger")
    if not files.exists(ledger):
        return None
    marked = [int(f.getPath().getName()) for f in files.listStatus(ledger)]
    marked = [b for b in marked if before is None or b < before]
    return spark.read.option("basePath", f"{where}/events").parquet(*[f"{where}/events/batch={b}" for b in marked]).drop("batch") if marked else None


def until_done(run: Callable[[], DataFrame], deaths: int) -> DataFrame:
    """Start a query again after each death, as its supervisor would, ``deaths`` times at most."""
    for _ in range(deaths):
        try:
            return run()
        except StreamingQueryException:
            continue
    return run()


def fan_out(stream: DataFrame, consumers: dict[str, Callable[[DataFrame], DataFrame]], where: str) -> dict[str, DataFrame]:
    """One stream to several consumers; a batch is done when all have written theirs."""

    def batch(df: DataFrame, b: int) -> None:
        df.persist()
        try:
            for name, consumer in consumers.items():
                consumer(df).write.mode("overwrite").parquet(f"{where}/{name}/batch={b}")
        finally:
            df.unpersist()

    run_to_end(stream, batch, where)
    return {n: stream.sparkSession.read.parquet(f"{where}/{n}").drop("batch") for n in consumers}


COUNTERS = ("scanned", "filtered", "retained", "failed", "vanished")


def running_stats(contributions: DataFrame, where: str) -> DataFrame:
    """Totals by replacement: the state is a directory's last contribution, a batch's output those that
    it replaced.  Of several with one sequence the greatest counts, compared by ``COUNTERS`` in their
    order, so the result depends neither on row order nor on batches.  The total is that of each
    directory's newest output."""
    # Whole contributions are compared by sorting; first they are brought together, so that each sort is small.
    last = contributions.repartition("dir").groupBy("dir").agg(F.max(F.struct("seq", *COUNTERS)).alias("last")).select("dir", "last.*")
    rows = collected(last, where, "update").groupBy("dir").agg(*[F.max_by(c, "batch").alias(c) for c in COUNTERS])
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


CURSOR = "round_at long, round_id string, attempt_at long, attempt_id string, sequence long, final boolean"


CURSOR_NAMES = [x.split()[0] for x in CURSOR.split(", ")]


def follows(report: tuple, last: tuple | None) -> bool:
    """Whether a report (round's start and id, attempt's start and id, sequence, final) advances the
    cursor: a later round or attempt under another id, or in the same attempt a later sequence,
    where nothing but a final report follows a final one."""
    if last is None:
        return True
    for k in (0, 2):
        if report[k] != last[k]:
            return report[k] > last[k] and report[k + 1] != last[k + 1]
        if report[k + 1] != last[k + 1]:
            return False
    return report[4] > last[4] and (report[5] or not last[5])


class ReportState(StatefulProcessor):
    """A task's reports: the cursor in a value state, batch ids and their contents in a list state.

    The list's entries expire after ``keep_ms``, so a task's state does not grow without end.  A
    micro-batch asks the state of a task for all it needs at once: a few calls a task, none a report."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.cursor = handle.getValueState("cursor", CURSOR)
        self.seen = handle.getListState("seen", "batch_id string, content string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = begun = self.cursor.get()
        # One micro-batch of one task, in order of arrival; of the known ids only those that come again.
        batch = sorted(rows, key=lambda r: (r["arrival"] is None, r["arrival"]))
        ids = {r["batch_id"] for r in batch} - {None}
        known = {batch_id: content for batch_id, content in self.seen.get() if batch_id in ids} if ids else {}
        fresh, out = [], []
        for r in batch:
            batch_id, content = r["batch_id"], r["content"]
            if batch_id in known:
                out.append("duplicate" if known[batch_id] == content else "conflict")
                continue
            if batch_id is not None:
                known[batch_id] = content
                fresh.append((batch_id, content))
            report = tuple(r[c] for c in CURSOR_NAMES)
            forward = follows(report, last)
            last = report if forward else last
            out.append("advanced" if forward else "stale")
        if fresh:
            self.seen.appendList(fresh)
        if last is not None and last != begun:
            self.cursor.update(last)
        for r, status in zip(batch, out):
            yield Row(task=key[0], arrival=r["arrival"], status=status)

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def report_states(reports: DataFrame, where: str, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """Each progress report (task, arrival, batch_id, content, and what ``follows`` reads) with its
    status: a batch id that came before is a ``duplicate`` with the same content and a ``conflict``
    with another; of the others those ``advanced`` move the task's cursor, the rest is ``stale``.

    One arbitrary state on RocksDB; called again, it goes on from its checkpoint.  Expiry needs
    processing time, which alone would ask for one empty batch after the other."""
    # The driver reads the processor in a Python process of its own, which has no shipped files.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    conf = ship(reports.sparkSession).conf
    needed = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {key: conf.get(key, None) for key in needed}
    for key, value in needed.items():
        conf.set(key, value)
    try:
        states = reports.groupBy("task").transformWithState(ReportState(keep_ms), "task long, arrival long, status string", "append", "processingTime")
        return collected(states, where).drop("batch")
    finally:
        for key, value in old.items():
            conf.unset(key) if value is None else conf.set(key, value)


def cursor_latest(reports: DataFrame, where: str) -> DataFrame:
    """Progress reports that advance their task's cursor; without batch ids none is a duplicate."""
    states = report_states(reports.withColumns({"batch_id": F.lit(None).cast("string"), "content": F.lit("")}), where)
    return states.where("status = 'advanced'").select("task", "arrival")


def diagnostic_batches(batches: DataFrame, where: str) -> DataFrame:
    """Batches (task, batch_id, content) by id: repeated ones are one, other content is a conflict."""
    seen = batches.groupBy("task", "batch_id").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    rows = collected(seen, where, "update").groupBy("task", "batch_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return rows.select("task", "batch_id", F.when(F.col("low") == F.col("high"), "stored").otherwise("conflict").alias("status"))


def pending(notes: DataFrame, where: str) -> DataFrame:
    """The highest revision seen per id: an acknowledgement holds though an older row comes late."""
    best = notes.groupBy("id").agg(F.max("delivery_revision").alias("revision"))
    rows = collected(best, where, "update")
    return rows.groupBy("id").agg(F.max("revision").alias("revision"))


def dedup_events(events: DataFrame, keys: list[str], time: str, delay: str, where: str) -> DataFrame:
    return collected(events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys), where).drop("batch")


def last_wins(stage: DataFrame, keys: list[str], sequence: str, where: str) -> DataFrame:
    """Per batch the last observation of a key by its source sequence, then over the round."""
    run_to_end(stage, lambda df, b: latest_by_key(df, keys, sequence).write.mode("overwrite").parquet(f"{where}/rows/batch={b}"), where)
    return latest_by_key(stage.sparkSession.read.parquet(f"{where}/rows").drop("batch"), keys, sequence)


def window_activity(events: DataFrame, where: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events per tumbling window; rows later than the watermark are dropped."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("entries"))
    rows = collected(counts.select(F.unix_micros("window.start").alias("start_us"), "event_type", "entries"), where, "update")  # a row per window and batch
    return rows.groupBy("start_us", "event_type").agg(F.max_by("entries", "batch").alias("entries"))


