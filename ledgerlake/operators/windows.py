"""Ordered operators: batches, contiguity, progress, intervals, logs, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settle


def pending_batch(notes: DataFrame, round_id: str, kind: int, after: int, rows: int = 64, payload: int = 4 << 20) -> DataFrame:
    """Unacknowledged notifications after a cursor: the first ``rows``, cut by running payload bytes."""
    first = notes.where((F.col("round_id") == round_id) & (F.col("kind") == kind) & (F.col("delivery_revision") == 0) & (F.col("sequence") > after)).orderBy("sequence").limit(rows)
    total = F.sum(F.octet_length("payload_json")).over(Window.orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("running_bytes", total).where(F.col("running_bytes") <= payload)


def batch_plan(notes: DataFrame, rows: int = 65536, payload: int = 8 << 20, slot: int = 1 << 16) -> DataFrame:
    """A batch number for every record of a backlog: soft bounds on rows and bytes, per round.

    Running totals are those of a round's slots of ``slot`` sequence numbers (a row a slot) plus
    those inside the slot, so no task holds a round."""
    size = F.octet_length("payload_json")
    slotted = notes.withColumn("_slot", F.floor(F.col("sequence") / slot))
    per = slotted.groupBy("round_id", "_slot").agg(F.count(F.lit(1)).alias("_rows"), F.sum(size).alias("_bytes"))
    before = Window.partitionBy("round_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("round_id", "_slot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"))
    w = Window.partitionBy("round_id", "_slot").orderBy("sequence")
    out = slotted.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(per, ["round_id", "_slot"])
    batch = F.greatest(F.floor((F.col("_n") + F.col("_r0") - 1) / rows), F.floor((F.col("_b") + F.col("_b0") - 1) / payload)).cast("long")
    return out.select(*notes.columns, batch.alias("batch"))


def history_violations(versions: DataFrame) -> DataFrame:
    """Rows of a history out of order or place, with a code; histories in order give none.

    A history begins at segment 0, index 0.  A segment's indexes run from 0 to its records - 1; all
    its rows have the same records and complete flag.  The next segment follows only a full, not
    complete one.  The latest version is the last row of the complete segment, and nothing follows it."""
    w = Window.partitionBy("relative_path").orderBy("history_segment", "history_index")
    was = {x: F.lag(x).over(w) for x in ("history_segment", "history_index", "history_records", "history_complete", "is_latest")}
    rows = versions.withColumns({f"_{k}": v for k, v in was.items()} | {"_last": F.lead("history_index").over(w).isNull()})
    seg, at, many, full = (F.col(f"history_{x}") for x in ("segment", "index", "records", "complete"))
    p_seg, p_at, p_many, p_full = (F.col(f"_history_{x}") for x in ("segment", "index", "records", "complete"))
    first, fresh = p_seg.isNull(), p_seg != seg
    code = (
        F.when(first & ((seg != 0) | (at != 0)), "first_index")
        .when(~first & F.col("_is_latest"), "after_latest")
        .when(fresh & ((seg != p_seg + 1) | (p_at + 1 != p_many) | p_full | (at != 0)), "segment")
        .when(~fresh & (at != p_at + 1), "gap")
        .when((~fresh & ((many != p_many) | (full != p_full))) | (at >= many), "boundary")
        .when(F.col("is_latest") & (~full | (at + 1 != many)), "latest_early")
        .when(F.col("_last") & ~F.col("is_latest"), "latest_not_last")
    )
    return rows.withColumn("violation", code).where("violation is not null").select(*versions.columns, "violation")


def feed_check(feed: DataFrame, maximum: int = 1000) -> DataFrame:
    """Per session: pages consecutive from 0, each of 1 to ``maximum`` entries whose ids follow on,
    nothing after the one terminal, and the declared count equal to the observed one."""
    w = Window.partitionBy("session").orderBy("page")
    expected = F.coalesce(F.sum("entries").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = feed.withColumn("_gap", (F.col("page") != F.row_number().over(w) - 1).cast("int")).withColumn("_after", (F.coalesce(F.lag("terminal").over(w), F.lit(False))).cast("int")).withColumn("_id", (F.col("first_id") != expected).cast("int"))
    per = j.groupBy("session").agg(F.max("_gap").alias("g"), F.max("_after").alias("a"), F.max("_id").alias("i"), F.sum("entries").alias("n"), F.max("declared").alias("d"), F.count_if("terminal").alias("t"), F.min("entries").alias("low"), F.max("entries").alias("high"))
    code = F.when(F.col("g") == 1, "page_gap").when(F.col("a") == 1, "after_terminal").when(F.col("t") != 1, "no_terminal").when((F.col("low") < 1) | (F.col("high") > maximum), "page_size").when(F.col("i") == 1, "id_gap").when(F.col("n") != F.col("d"), "count").otherwise("ok")
    return per.select("session", code.alias("status"))


def progress_rate(samples: DataFrame) -> DataFrame:
    """Bytes a second between samples; the average since the start for short gaps or no new bytes."""
    w = Window.partitionBy("task").orderBy("sequence")
    dt, db = F.col("at_s") - F.lag("at_s").over(w), F.col("bytes") - F.lag("bytes").over(w)
    start = F.first("at_s").over(w)
    average = F.when(F.col("at_s") > start, F.col("bytes") / (F.col("at_s") - start)).otherwise(0.0)
    return samples.withColumn("rate", F.when((dt > 0.1) & (db > 0), db / dt).otherwise(average))


def interval_union(ranges: DataFrame, key: str | None = "file_id", slot: int = 1 << 26) -> DataFrame:
    """Disjoint ranges per key (of one long line without a key): overlapping and adjacent ones merge,
    empty ones go.

    A segmented prefix maximum: ranges are merged inside slots of their start first.  What reaches
    beyond its slot is known from the furthest end of the key's earlier slots (a row a slot), so
    every slot counts its own new ranges, and the ranges of one number, over all slots, are one.
    No task holds a key."""
    keys = [key] if key else []
    at = [*keys, "_slot"]
    inside = Window.partitionBy(*at).orderBy("start_off", "end_off")
    until, so_far = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.where("end_off > start_off").withColumn("_slot", F.floor(F.col("start_off") / slot))
    rows = rows.withColumn("_new", F.coalesce((F.col("start_off") > F.max("end_off").over(until)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(so_far)).groupBy(*at, "_island").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off")).drop("_island")
    # Ranges of a slot are disjoint now, so only an earlier slot's reach continues one.
    rows = rows.join(slot_reach(rows, key), at).withColumn("_new", F.coalesce((F.col("start_off") > F.col("_reach")).cast("int"), F.lit(1)))
    many = rows.groupBy(*at).agg(F.sum("_new").alias("_many"))
    before = many.select(*at, F.coalesce(F.sum("_many").over(_earlier(key)), F.lit(0)).alias("_before"))
    rows = rows.join(before, at).withColumn("_island", F.col("_before") + F.sum("_new").over(so_far))
    return rows.groupBy(*keys, "_island").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off")).drop("_island")


def _earlier(key: str | None):
    """A key's slots before a slot; they are a row each."""
    return (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)


def slot_reach(rows: DataFrame, key: str | None) -> DataFrame:
    """Per slot the furthest end of its key's earlier slots."""
    at = [*([key] if key else []), "_slot"]
    return rows.groupBy(*at).agg(F.max("end_off").alias("_end")).select(*at, F.max("_end").over(_earlier(key)).alias("_reach"))


def interval_missing(merged: DataFrame, totals: DataFrame, key: str = "file_id", slot: int = 1 << 26) -> DataFrame:
    """Uncovered ranges of [0, total) per file, slot by slot as in ``interval_union``."""
    ends = merged.select(key, "start_off", "end_off").unionByName(totals.select(key, F.col("total").alias("start_off"), F.col("total").alias("end_off")))
    rows = ends.withColumn("_slot", F.floor(F.col("start_off") / slot))
    until = Window.partitionBy(key, "_slot").orderBy("start_off", "end_off").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.max("end_off").over(until)).join(slot_reach(rows, key), [key, "_slot"]).join(totals, key)
    rows = rows.withColumn("gap_start", F.coalesce(F.greatest("_near", "_reach"), F.lit(0)))
    return rows.withColumn("gap_end", F.least("start_off", "total")).where("gap_start < gap_end").select(key, "gap_start", "gap_end").distinct()


def covers(merged: DataFrame, totals: DataFrame, key: str = "file_id", slot: int = 1 << 26) -> DataFrame:
    missing = interval_missing(merged, totals, key, slot).groupBy(key).agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("missing"))
    return totals.join(missing, key, "left").select(key, F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("covers"))


def log_windows(logs: DataFrame, margin_us: int, slot_us: int = 3_600_000_000) -> DataFrame:
    """Per error path the span of its trace lines with a margin; overlapping windows merged."""
    bad = logs.where("level = 'ERROR'").select("path").distinct()
    spans = logs.join(bad, "path", "left_semi").groupBy("path").agg((F.min("at_us") - margin_us).alias("start_off"), (F.max("at_us") + margin_us).alias("end_off"))
    return interval_union(spans, None, slot_us)


def compression(logs: DataFrame, shown: DataFrame) -> DataFrame:
    """How many lines of a log its windows show, and the share that is left out."""
    seen = shown.select("line").distinct().withColumn("_shown", F.lit(1))
    counts = logs.select("line").join(seen, "line", "left").agg(F.count(F.lit(1)).alias("lines"), F.count("_shown").alias("shown"))
    return counts.withColumn("left_out", F.when(F.col("lines") > 0, 1 - F.col("shown") / F.col("lines")).otherwise(0.0))


def in_windows(logs: DataFrame, windows: DataFrame, at: str = "at_us") -> DataFrame:
    """Lines inside disjoint windows, with their window: a sorted sweep, no join of the two.

    Window starts and lines are sorted together by range.  The last window opened before a line is
    carried through its partition, and from the partitions before it by a row each; the line is
    inside if that window has not ended.  Lines of one moment may lie in several partitions."""
    n = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    opened = windows.select(F.col("start_off").alias("_at"), F.struct("start_off", "end_off").alias("_window"))
    both = logs.select(F.col(at).alias("_at"), F.struct("*").alias("_row")).unionByName(opened, allowMissingColumns=True)
    order = ["_at", F.col("_row").isNotNull(), F.xxhash64("_row")]
    swept = both.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    swept = settle(swept).withColumn("_part", F.shiftright("_id", 33))  # both readers must see the same partitions
    last = swept.groupBy("_part").agg(F.max("_window").alias("_last"))
    carried = last.select("_part", F.max("_last").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    here = F.max("_window").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = swept.withColumn("_here", here).join(carried, "_part").withColumn("_open", F.coalesce("_here", "_carried"))
    return rows.where("_row is not null and _at <= _open.end_off").select("_row.*", "_open.start_off", "_open.end_off")


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def head_of_each(df: DataFrame, keys: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key; every task keeps its own first ones before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def cap_omitted(diagnostics: DataFrame, capacity: int = 512, batch: int = 64) -> DataFrame:
    """The first diagnostics per round, their batch, and how many the round omitted.

    The first ``capacity`` are a partial top-n in every task, the totals an aggregate."""
    totals = diagnostics.groupBy("round").agg(F.count(F.lit(1)).alias("_all"))
    first = diagnostics.select("round", "event_id").withColumn("rn", F.row_number().over(Window.partitionBy("round").orderBy("event_id"))).where(F.col("rn") <= capacity)
    return first.join(totals, "round").select("round", "event_id", F.floor((F.col("rn") - 1) / batch).cast("long").alias("batch"), F.greatest(F.col("_all") - capacity, F.lit(0)).alias("omitted"))


def places(df: DataFrame, *order: Column | str) -> DataFrame:
    """Every row's place in an order, from 1: a range-partitioned sort whose rows are numbered in
    their partition and, by the sizes of those before it (a row a partition), over all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = settle(rows)  # both readers below must see the same partitions
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(before, "_part").select(*df.columns, place.cast("long").alias("place"))
