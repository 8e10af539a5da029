"""Policy, log, source, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs, policy, windows
from ..plans.fixtures import Tables
from ..shared import shared_folder
from ..sources import io
from ..streaming import streams
from . import query
from .stats import _DS, dir_stats


@query("base_x", sql="SELECT k, CASE WHEN generation=2 THEN 1 ELSE generation END AS generation FROM base_x")
def gen_begin_rebase(t: Tables):
    return policy.begin_rebase(t("base_x"), 2, 1).select("k", "generation")


@query("copy_runs", sql="SELECT job_id, max(sequence) AS committed, count(*) AS runs FROM copy_runs WHERE phase='completed' AND sequence%2=0 GROUP BY 1")
def gen_commit(t: Tables):
    return policy.commit(t("copy_runs"), t("copy_runs").where("sequence%2=0"))


@query("entries", sql="SELECT job_id, count(*) AS rows, CAST(sum(CASE WHEN job_id=2 THEN size+1 ELSE size END) AS BIGINT) AS bytes, CAST(CASE WHEN job_id=2 THEN 2 ELSE 1 END AS BIGINT) AS runs, CAST(CASE WHEN job_id=2 THEN 2 ELSE 1 END AS BIGINT) AS committed FROM entries GROUP BY 1")
def gen_commit_round(t: Tables):
    """A round of all jobs, its replay, a round of one job, and one that crashes with half of its
    partitions written: readers see the last committed run of every job."""
    where = shared_folder(t.spark, "rounds")
    rows = t("entries").select("k", "relative_path", "job_id", "size")
    for _ in range(2):
        io.commit_round(rows, where, "r1", 1)
    io.commit_round(rows.where("job_id=2").withColumn("size", F.col("size") + 1), where, "r2", 2)
    io.write_snapshot(rows.where("job_id<2").withColumn("size", F.lit(0)), where, "r3")  # and no run row
    seen = io.committed(t.spark, where).groupBy("job_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    runs = t.spark.read.parquet(f"{where}/runs").groupBy("job_id").agg(F.count(F.lit(1)).alias("runs"), F.max("sequence").alias("committed"))
    return seen.join(runs, "job_id")


@query("copy_runs", sql="SELECT job_id, baseline_prepared AND phase='completed' AS baseline FROM copy_runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC)=1")
def gen_baseline(t: Tables):
    return policy.has_baseline(t("copy_runs"))


@query("copy_runs", sql="""p AS (SELECT *, lag(sequence) OVER o AS ps, lag(phase) OVER o AS pp, lag(baseline_prepared) OVER o AS pb, lag(retains_source) OVER o AS pr, lag(binding) OVER o AS pn, lag(contract) OVER o AS pc, lag(selection_key) OVER o AS pk FROM copy_runs WINDOW o AS (PARTITION BY job_id ORDER BY sequence)),
q AS (SELECT *, ps IS NULL OR NOT pr OR pp='accepted' OR NOT pb OR NOT baseline_available AS full_, coalesce(pk<>selection_key,FALSE) AS sel FROM p), r AS (SELECT *, NOT full_ AND pc<>contract AS force_, full_ OR filtered OR relative_time OR sel OR NOT retains_source AS keep_ FROM q),
e AS (SELECT *, CASE WHEN coalesce(pn<>binding,FALSE) THEN 'binding_changed' WHEN delete_target AND keep_ THEN 'target_cleanup_conflict' END AS error FROM r)
SELECT job_id, sequence, error, CASE WHEN error IS NULL THEN CASE WHEN full_ THEN 'full' ELSE 'incremental' END END AS mode, CASE WHEN error IS NULL THEN CASE WHEN keep_ THEN 'preserve' ELSE 'confirm_absent_within_scope' END END AS target_policy,
CASE WHEN error IS NULL THEN concat_ws(',', CASE WHEN ps IS NULL THEN 'first_generation' WHEN NOT pr THEN 'previous_source_deleted' WHEN full_ THEN 'baseline_unavailable' ELSE 'retained_source_facts' END, CASE WHEN relative_time THEN 'relative_time_window' END, CASE WHEN filtered THEN 'filtered_selection' END, CASE WHEN sel THEN 'selection_changed' END, CASE WHEN NOT retains_source THEN 'source_cleanup' END, CASE WHEN force_ THEN 'contract_changed' END) END AS reasons,
CASE WHEN error IS NULL THEN coalesce(force_,FALSE) END AS force_copy FROM e""")  # fmt: skip
def gen_plan(t: Tables):
    return policy.plan(t("copy_runs"))


@query("base_x", "work_x", sql="SELECT k, copy_sequence, CASE WHEN copy_sequence<2 THEN 1 ELSE generation END AS generation FROM (SELECT k, copy_sequence, generation FROM base_x UNION ALL SELECT k, copy_sequence, generation FROM work_x)")
def gen_prepare(t: Tables):
    u = t("base_x").select("k", "copy_sequence", "generation").unionAll(t("work_x").select("k", "copy_sequence", "generation"))
    return policy.prepare(u, "incremental", 2, 1)


@query("base_x", "work_x", sql="SELECT k, copy_sequence FROM work_x")
def gen_retire(t: Tables):
    u = t("base_x").select("k", "copy_sequence").unionAll(t("work_x").select("k", "copy_sequence"))
    return policy.retire(u, 1)


@query("base_x", "work_x", sql="SELECT count(*) AS leftovers FROM base_x WHERE k%10=0")
def gen_retire_leftovers(t: Tables):
    """After a retirement that missed some rows of the run."""
    u = t("base_x").where("k%10=0").select("k", "copy_sequence").unionAll(t("work_x").select("k", "copy_sequence"))
    return policy.leftovers(u, 1)


@query("events_log", sql="SELECT round, greatest(1704700000000000, max(create_at)+1) AS epoch FROM events_log GROUP BY 1")
def gen_event_epoch(t: Tables):
    return policy.event_epoch(t("events_log"), 1704700000000000)


@query("copy_runs", sql="SELECT job_id, sequence, execution_id, phase FROM copy_runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC)=1")
def lim_latest_run(t: Tables):
    return policy.latest_run(t("copy_runs")).select("job_id", "sequence", "execution_id", "phase")


def spans(t: Tables):
    """Logs with two spans each: the job's, and the worker's with its path."""
    row = lambda name, recv, path: F.struct(F.lit(name).alias("name"), F.col("job_id").alias("job_id"), recv.cast("long").alias("recv_id"), path.alias("path"))
    none = F.lit(None)
    return t("logs").withColumn("spans", F.array(row("job", none, none.cast("string")), row("worker", F.col("recv_id"), F.col("path"))))


@query("logs", sql="SELECT line FROM logs WHERE path='p/7/1'")
def log_by_path(t: Tables):
    return logs.by_path(spans(t), "p/7/1").select("line")


@query("logs", sql="SELECT line FROM logs WHERE job_id='j3'")
def log_by_job(t: Tables):
    return logs.by_job(spans(t), "j3").select("line")


@query("logs", sql="SELECT line, at_us, message FROM logs WHERE level='ERROR'")
def log_errors(t: Tables):
    return logs.errors(spans(t)).select("line", "at_us", "message")


@query("logs", sql="SELECT recv_id, count(*) AS errors FROM logs WHERE level='ERROR' GROUP BY 1")
def log_errors_per_worker(t: Tables):
    return logs.errors_per_worker(spans(t))


@query("logs", sql="SELECT DISTINCT path FROM logs WHERE recv_id=5")
def log_worker_paths(t: Tables):
    return logs.worker_paths(spans(t), 5)


@query("logs", sql="SELECT DISTINCT path FROM logs WHERE level='ERROR'")
def log_failed_paths(t: Tables):
    return logs.failed_paths(spans(t))


@query("logs", sql="SELECT line FROM logs WHERE level='ERROR' AND at_us>=1704100000000000 AND at_us<1704300000000000")
def log_errors_between(t: Tables):
    return logs.errors_between(spans(t), 1704100000000000, 1704300000000000).select("line")


@query("logs", sql="SELECT line, at_us, regexp_extract(message,'failed \"([^\"]+)\"',1) AS failed_path FROM logs WHERE regexp_matches(message,'failed \"[^\"]+\"')")
def log_text_failed(t: Tables):
    return logs.text_failed(t("logs")).select("line", "at_us", "failed_path")


_TRACED = """lg AS (SELECT line, at_us, level, message, CASE WHEN level='ERROR' AND line%5=0 THEN concat('lost/',CAST(line AS VARCHAR)) ELSE path END AS path FROM logs), e AS (SELECT at_us, path AS error_path FROM lg WHERE level='ERROR' UNION SELECT at_us, regexp_extract(message,'failed "([^"]+)"',1) FROM lg WHERE level='ERROR'),
b AS (SELECT DISTINCT error_path FROM e), m AS (SELECT message, error_path FROM (SELECT DISTINCT message FROM lg) JOIN b ON contains(message, error_path)), f AS (SELECT line, level, error_path FROM lg JOIN b ON path=error_path UNION SELECT line, level, error_path FROM lg JOIN m USING (message)),
o AS (SELECT * FROM e WHERE error_path NOT IN (SELECT error_path FROM f WHERE level<>'ERROR'))
SELECT line, error_path, 'trace' AS why FROM f UNION ALL SELECT DISTINCT l.line, o.error_path, 'window' FROM lg l JOIN o ON l.at_us BETWEEN o.at_us-60000000 AND o.at_us+60000000 WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.line=l.line AND f.error_path=o.error_path)"""


@query("logs", sql=_TRACED)
def log_trace_chain(t: Tables):
    path = F.when((F.col("level") == "ERROR") & (F.col("line") % 5 == 0), F.concat(F.lit("lost/"), F.col("line").cast("string"))).otherwise(F.col("path"))
    rows = t("logs").withColumn("path", path).withColumn("spans", F.array(F.struct("path")))
    return logs.trace_chain(rows).select("line", "error_path", "why")


@query("logs", sql="SELECT line, message FROM logs WHERE execution=2 AND level='INFO' ORDER BY at_us, line LIMIT 10 OFFSET 30")
def log_page(t: Tables):
    return windows.page(t("logs").where("execution=2 and level='INFO'"), ["at_us", "line"], 30, 10).select("line", "message")


@query("entries", sql="SELECT k, relative_path, size, entry_kind FROM entries WHERE job_id=1")
def src_catalogue(t: Tables):
    where = shared_folder(t.spark, "src")
    io.publish(t("entries").drop("entry_kind", "size_observed"), where)
    return io.read_catalogue(t.spark, where, 1).join(t("entries").select("relative_path", "k"), "relative_path").select("k", "relative_path", "size", "entry_kind")


@query("work", sql="SELECT k FROM work WHERE k%5=1")
def src_file_list(t: Tables):
    text = F.when(F.col("k") % 5 == 0, F.concat(F.lit("# "), "relative_path")).when(F.col("k") % 5 == 1, F.concat(F.lit("  "), "relative_path", F.lit(" "))).when(F.col("k") % 5 == 2, F.concat(F.lit("/"), "relative_path")).when(F.col("k") % 5 == 3, F.concat(F.lit("a/../"), "relative_path")).otherwise(F.lit("   "))
    return io.select_listed(t("work"), io.file_list(t("work").select(text.alias("value")))).select("k")


def _log_files(t: Tables, value) -> DataFrame:
    """The log as text files, one per execution, each in the order of its lines; read again in splits."""
    where = shared_folder(t.spark, "log")
    rows = t("logs").select("execution", "line", value.alias("value")).repartition("execution").sortWithinPartitions("execution", "line")
    rows.select("execution", "value").write.partitionBy("execution").text(where)
    return io.numbered_lines(t.spark, f"{where}/*").withColumn("file", F.regexp_extract("file", r"execution=(\d+)", 1))


_NUMBERED = "n AS (SELECT *, CAST(execution AS VARCHAR) AS file, row_number() OVER (PARTITION BY execution ORDER BY line) AS number FROM logs) "


@query("logs", sql=_NUMBERED + "SELECT file, number AS line, at_us, level, message, path FROM n WHERE line%7<>0")
def src_log_json(t: Tables):
    rec = F.to_json(F.struct(F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "level", F.struct("message").alias("fields"), F.array(F.struct(F.lit("w").alias("name"), "path")).alias("spans")))
    lines = _log_files(t, F.when(F.col("line") % 7 == 0, "not json").otherwise(rec))
    return io.parse_log_json(lines).select("file", "line", "at_us", "level", "message", F.col("spans")[0]["path"].alias("path"))


@query("logs", sql=_NUMBERED + "SELECT file, number AS line, at_us, level, message FROM n WHERE line%7<>0")
def src_log_text(t: Tables):
    text = F.concat_ws(" ", F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "level", "message")
    return io.parse_log_text(_log_files(t, F.when(F.col("line") % 7 == 0, "  at frame 1").otherwise(text)))


@query("entries", sql="SELECT k, job_id, CASE WHEN job_id=2 THEN size+1 ELSE size END AS size FROM entries")
def snk_catalogue(t: Tables):
    where = shared_folder(t.spark, "catalogue")
    io.publish(t("entries"), where)
    io.publish(t("entries").where("job_id=2").withColumn("size", F.col("size") + 1), where)
    return t.spark.read.parquet(where).select("k", F.col("job_id").cast("long").alias("job_id"), "size")


@query("events_log", sql="SELECT round, count(*) AS rows, count(*) AS numbers, CAST(1 AS BIGINT) AS lowest, count(*) AS highest FROM (SELECT DISTINCT round, op, path, version_id FROM events_log) GROUP BY 1")
def snk_events(t: Tables):
    where = shared_folder(t.spark, "events")
    rows = t("events_log").select("round", "op", "path", "version_id", "bytes", "create_at")
    for part in (rows.where("bytes%2=0"), rows.where("bytes%3=0"), rows):
        io.append_events(t.spark, where, part)
    return t.spark.read.parquet(where).groupBy("round").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("create_at").alias("numbers"), F.min("create_at").alias("lowest"), F.max("create_at").alias("highest"))


@query("entries", sql="SELECT concat(regexp_replace(relative_path,'/[^/]*$',''),'.tar') AS tar_path, relative_path AS entry_path, entry_kind, size, mtime_ns FROM entries")
def snk_manifest(t: Tables):
    where = shared_folder(t.spark, "manifest")
    io.manifest(t("entries")).write.parquet(where)
    return t.spark.read.parquet(where)


@query("entries", sql="SELECT 'entries' AS part, k, job_id FROM entries WHERE job_id<>3 UNION ALL SELECT 'links', k, job_id FROM entries WHERE is_symlink AND job_id<>3")
def mnt_clear_job(t: Tables):
    """One job's partitions of two shared tables are dropped, twice over."""
    tables = {p: shared_folder(t.spark, p) for p in ("entries", "links")}
    rows = t("entries").select("k", "relative_path", "job_id", "is_symlink")
    io.publish(rows, tables["entries"])
    io.publish(rows.where("is_symlink"), tables["links"])
    for _ in range(2):
        io.clear_job(t.spark, list(tables.values()), 3)
    left = [t.spark.read.parquet(where).select(F.lit(p).alias("part"), "k", F.col("job_id").cast("long").alias("job_id")) for p, where in tables.items()]
    return left[0].union(left[1])


def _events(t: Tables):
    return streams.event_stream(t.spark, t.sf_dir)


@query("events_log", sql="SELECT 'stats' AS consumer, count(*) AS rows FROM events_log UNION ALL SELECT 'errors', count(*) FROM events_log WHERE op='error'")
def snk_fanout(t: Tables):
    out = streams.fan_out(_events(t), {"stats": lambda df: df, "errors": lambda df: df.where("event_type='error'")}, shared_folder(t.spark, "fanout"))
    count = lambda n: out[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("consumer"), "rows")
    return count("stats").union(count("errors"))


def _stage_stream(t: Tables):
    """The current listing as a stream: written once to the shared folder, as it is partitioned, in
    four files at least, then read as files in two batches, since each meets the whole baseline."""
    where, rows = shared_folder(t.spark, "stage"), t("work_x")
    parts = rows.rdd.getNumPartitions()
    (rows if parts >= 4 else rows.repartition(4, "relative_path")).write.parquet(where)
    written = t.spark.read.parquet(where)
    half = -(-len(written.inputFiles()) // 2)
    return t.spark.readStream.schema(written.schema).option("maxFilesPerTrigger", half).parquet(where)


def _register_streams() -> None:
    from .compare import _SCAN, _rename

    @query("base_x", "work_x", sql=_SCAN)
    def str_compare(t: Tables):
        return streams.compare_stream(_stage_stream(t), t("base_x"), shared_folder(t.spark, "compare")).select("k", "event", "displaced")

    @query("base_x", "work_x", sql=_rename("base_x", "work_x", "(SELECT NULL AS operation_type, NULL AS relative_path, NULL AS version_id, NULL AS file_handle, NULL AS comment WHERE FALSE)"))
    def str_finalize(t: Tables):
        return streams.finalize(_stage_stream(t), t("base_x"), shared_folder(t.spark, "finalize"))


_register_streams()


@query("events_log", "events", sql="SELECT round, event_type AS op, path, count(*) AS rows, TRUE AS kept, TRUE AS dense FROM events_log JOIN events USING (event_id) GROUP BY 1,2,3")
def str_exactly_once(t: Tables):
    """The query dies before the sink, between sink and ledger, and between ledger and checkpoint,
    each in another batch, and is started again; numbers once written stay, and leave no gaps."""
    stage, where = shared_folder(t.spark, "feed"), shared_folder(t.spark, "once")
    rows = t("events").select((F.col("event_id") % 3).alias("round"), F.col("event_type").alias("op"), F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("path"), F.lit("").alias("version_id"), F.lit(0).cast("long").alias("create_at"))
    rows.union(rows.where("round=1")).repartition(6, "path").write.parquet(stage)
    deaths = {("begun", 0), ("written", 1), ("recorded", 2)}

    def at(place: str, batch: int) -> None:
        if (place, batch) in deaths:
            deaths.remove((place, batch))
            if place == "written":  # what the batch wrote before it died
                t.spark.read.parquet(f"{where}/events/batch={batch}").write.parquet(f"{where}/first")
            raise RuntimeError(f"killed: {place} {batch}")

    def run():
        source = t.spark.readStream.schema(t.spark.read.parquet(stage).schema).option("maxFilesPerTrigger", 2).parquet(stage)
        return streams.exactly_once(source, where, at)

    events = streams.until_done(run, len(deaths))
    if deaths:
        raise RuntimeError(f"places not reached: {deaths}")
    key = ["round", "op", "path", "version_id"]
    first = t.spark.read.parquet(f"{where}/first").select(*key, F.col("create_at").alias("first_at"))
    dense = events.groupBy("round").agg((F.count_distinct("create_at") == F.max("create_at")).alias("dense"))
    events = events.join(first, key, "left").groupBy("round", "op", "path").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.coalesce(F.col("create_at") == F.col("first_at"), F.lit(True))).alias("kept"))
    return events.join(dense, "round")


@query("dir_stats", sql=_DS + " SELECT scanned, filtered, retained, failed, vanished FROM s")
def str_stats(t: Tables):
    where = shared_folder(t.spark, "dirs")
    dir_stats(t).repartition(4).write.parquet(where)
    stream = t.spark.readStream.schema(t.spark.read.parquet(where).schema).option("maxFilesPerTrigger", 2).parquet(where)
    return streams.running_stats(stream, shared_folder(t.spark, "stats"))


_FOLLOWS = """CASE WHEN r.round_at<>c.round_at THEN r.round_at>c.round_at AND r.round_id<>c.round_id WHEN r.round_id<>c.round_id THEN FALSE WHEN r.attempt_at<>c.attempt_at THEN r.attempt_at>c.attempt_at AND r.attempt_id<>c.attempt_id
 WHEN r.attempt_id<>c.attempt_id THEN FALSE ELSE r.sequence>c.sequence AND (r.final OR NOT c.final) END"""
_CURSOR = ", ".join(f"CASE WHEN {_FOLLOWS} THEN r.{x} ELSE c.{x} END" for x in ("round_at", "round_id", "attempt_at", "attempt_id", "sequence", "final"))


@query("reports", sql=f"""SELECT task, arrival FROM (WITH RECURSIVE c AS (SELECT task, rn, arrival, TRUE AS ok, round_at, round_id, attempt_at, attempt_id, sequence, final FROM reports WHERE rn=0
 UNION ALL SELECT r.task, r.rn, r.arrival, {_FOLLOWS}, {_CURSOR} FROM c JOIN reports r ON r.task=c.task AND r.rn=c.rn+1) SELECT * FROM c) WHERE ok""")  # fmt: skip
def str_cursor_latest(t: Tables):
    """The reports come in three parts; after each the stream is stopped and started again."""
    where, out = shared_folder(t.spark, "reports"), shared_folder(t.spark, "cursor")
    rows = t("reports").withColumn("part", F.least(F.floor(F.col("rn") / 30), F.lit(2)))
    for part in range(3):
        rows.where(F.col("part") == part).drop("part", "rn").write.mode("append").parquet(where)
        accepted = streams.cursor_latest(t.spark.readStream.schema(t.spark.read.parquet(where).schema).parquet(where), out)
    return accepted


_FIRST = "f AS (SELECT *, CAST(arrival%40 AS STRING) AS batch_id, CAST(CASE WHEN arrival%9=0 THEN arrival ELSE 0 END AS STRING) AS content FROM reports), o AS (SELECT *, row_number() OVER (PARTITION BY task, batch_id ORDER BY arrival) AS place, first_value(content) OVER (PARTITION BY task, batch_id ORDER BY arrival) AS known FROM f), z AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY task ORDER BY arrival)-1 AS rn FROM o WHERE place=1)"


@query("reports", sql=f"""{_FIRST} SELECT task, arrival, CASE WHEN content=known THEN 'duplicate' ELSE 'conflict' END AS status FROM o WHERE place>1 UNION ALL SELECT task, arrival, CASE WHEN ok THEN 'advanced' ELSE 'stale' END FROM (WITH RECURSIVE c AS (SELECT task, rn, arrival, TRUE AS ok, round_at, round_id, attempt_at, attempt_id, sequence, final FROM z WHERE rn=0
 UNION ALL SELECT r.task, r.rn, r.arrival, {_FOLLOWS}, {_CURSOR} FROM c JOIN z r ON r.task=c.task AND r.rn=c.rn+1) SELECT * FROM c)""")  # fmt: skip
def str_report_states(t: Tables):
    """Reports with batch ids, in two parts with a restart in between: duplicates, conflicts and the
    cursor out of one state."""
    where, out = shared_folder(t.spark, "reports"), shared_folder(t.spark, "states")
    rows = t("reports").withColumns({"batch_id": (F.col("arrival") % 40).cast("string"), "content": F.when(F.col("arrival") % 9 == 0, F.col("arrival")).otherwise(0).cast("string")})
    for part in ("rn < 20", "rn >= 20"):
        rows.where(part).drop("rn").write.mode("append").parquet(where)
        states = streams.report_states(t.spark.readStream.schema(t.spark.read.parquet(where).schema).parquet(where), out)
    return states


@query("events_log", sql="SELECT task, batch_id, CASE WHEN min(content)=max(content) THEN 'stored' ELSE 'conflict' END AS status FROM (SELECT user_id AS task, concat('b',CAST(event_id%50 AS STRING)) AS batch_id, concat('c',CAST(CASE WHEN event_id%7=0 THEN event_id ELSE 0 END AS STRING)) AS content FROM events_log) GROUP BY 1,2")
def str_diagnostic_batches(t: Tables):
    content = F.concat(F.lit("c"), F.when(F.col("event_id") % 7 == 0, F.col("event_id")).otherwise(0).cast("string"))
    batches = _events(t).select(F.col("user_id").alias("task"), F.concat(F.lit("b"), (F.col("event_id") % 50).cast("string")).alias("batch_id"), content.alias("content"))
    return streams.diagnostic_batches(batches, shared_folder(t.spark, "batches"))


@query("events_log", sql="SELECT id, max(r) AS revision FROM (SELECT concat('n',CAST(event_id%4000 AS STRING)) AS id, CASE WHEN event_id%3=0 THEN 1 ELSE 0 END AS r FROM events_log) GROUP BY 1")
def str_pending(t: Tables):
    notes = _events(t).select(F.concat(F.lit("n"), (F.col("event_id") % 4000).cast("string")).alias("id"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("delivery_revision"))
    return streams.pending(notes, shared_folder(t.spark, "pending"))


def _twice(t: Tables, name: str, again, run):
    """All events as a stream that runs to its end, then ``again`` (events, newest time) as a second
    part of it, read from the checkpoint of the first."""
    where, out = shared_folder(t.spark, name), shared_folder(t.spark, f"{name}-out")
    events = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = events.agg(F.max("ts").alias("t")).head()["t"]
    for part in (events, again(events, F.lit(newest))):
        part.write.mode("append").parquet(where)
        result = run(t.spark.readStream.schema(t.spark.read.parquet(where).schema).parquet(where), out)
    return result


@query("events_log", sql="SELECT event_id, user_id FROM events_log")
def str_dedup_events(t: Tables):
    """Replays of the last days are known, those of older events are late; neither comes twice."""
    again = lambda e, newest: e.where((F.col("event_id") % 5 == 0) & ((F.col("ts") > newest - F.expr("interval 5 days")) | (F.col("ts") < newest - F.expr("interval 8 days"))))
    return _twice(t, "dedup", again, lambda s, out: streams.dedup_events(s.select("event_id", "user_id", "ts"), ["event_id"], "ts", "7 days", out)).select("event_id", "user_id")


@query("events_log", sql="SELECT user_id, max(event_id) AS event_id, max_by(bytes, event_id) AS bytes FROM events_log GROUP BY 1")
def str_last_wins(t: Tables):
    e = _events(t).select("user_id", "event_id", F.floor(F.col("value") * 100).cast("long").alias("bytes"))
    return streams.last_wins(e, ["user_id"], "event_id", shared_folder(t.spark, "last"))


@query("events", sql="SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS entries FROM events GROUP BY 1,2")
def str_window_activity(t: Tables):
    """Events that come again after a day are later than the watermark and are not counted."""
    again = lambda e, newest: e.where((F.col("event_id") % 5 == 0) & (F.col("ts") < newest - F.expr("interval 1 day")))
    return _twice(t, "activity", again, streams.window_activity)
