"""Generations and policy over run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import latest_by_key


def begin_rebase(df: DataFrame, working: int, committed: int) -> DataFrame:
    """Rows of an uncommitted working generation count as committed before a retry."""
    return df.withColumn("generation", F.when(F.col("generation") == working, F.lit(committed)).otherwise(F.col("generation")))


def has_baseline(runs: DataFrame) -> DataFrame:
    """Per job whether its newest run has a committed baseline."""
    return latest_by_key(runs, ["job_id"], "sequence").select("job_id", (F.col("baseline_prepared") & (F.col("phase") == "completed")).alias("baseline"))


def plan(runs: DataFrame) -> DataFrame:
    """Each run against the job's previous one: mode, target policy, reasons, forced copy, or an error."""
    w = Window.partitionBy("job_id").orderBy("sequence")
    prev = {x: F.lag(x).over(w) for x in ("sequence", "phase", "baseline_prepared", "retains_source", "binding", "contract", "selection_key")}
    rows = runs.withColumns({f"p_{k}": v for k, v in prev.items()})
    first = F.col("p_sequence").isNull()
    full = first | ~F.col("p_retains_source") | (F.col("p_phase") == "accepted") | ~F.col("p_baseline_prepared") | ~F.col("baseline_available")
    reason = F.when(first, "first_generation").when(~F.col("p_retains_source"), "previous_source_deleted").when(full, "baseline_unavailable").otherwise("retained_source_facts")
    selection = F.coalesce(F.col("p_selection_key") != F.col("selection_key"), F.lit(False))
    force = ~full & (F.col("p_contract") != F.col("contract"))
    reasons = F.array_compact(F.array(reason, F.when(F.col("relative_time"), "relative_time_window"), F.when(F.col("filtered"), "filtered_selection"), F.when(selection, "selection_changed"), F.when(~F.col("retains_source"), "source_cleanup"), F.when(force, "contract_changed")))
    preserve = full | F.col("filtered") | F.col("relative_time") | selection | ~F.col("retains_source")
    error = F.when(F.coalesce(F.col("p_binding") != F.col("binding"), F.lit(False)), "binding_changed").when(F.col("delete_target") & preserve, "target_cleanup_conflict")
    return rows.select(
        "job_id", "sequence", F.when(error.isNull(), F.when(full, "full").otherwise("incremental")).alias("mode"), F.when(error.isNull(), F.when(preserve, "preserve").otherwise("confirm_absent_within_scope")).alias("target_policy"),
        F.when(error.isNull(), F.array_join(reasons, ",")).alias("reasons"), F.when(error.isNull(), F.coalesce(force, F.lit(False))).alias("force_copy"), error.alias("error"),
    )


def prepare(base: DataFrame, mode: str, sequence: int, committed: int) -> DataFrame:
    """Full: rows of older sequences go.  Incremental: they are relabelled as committed."""
    if mode == "full":
        return base.where(F.col("copy_sequence") >= sequence)
    return base.withColumn("generation", F.when(F.col("copy_sequence") < sequence, F.lit(committed)).otherwise(F.col("generation")))


def retire(base: DataFrame, run: int) -> DataFrame:
    """What stays after a source-removing run: rows outside 0 < sequence <= run."""
    return base.where(~((F.col("copy_sequence") > 0) & (F.col("copy_sequence") <= run)))


def leftovers(base: DataFrame, run: int) -> DataFrame:
    """How many rows a retirement of ``run`` has left behind; any is an error."""
    return base.agg(F.count_if((F.col("copy_sequence") > 0) & (F.col("copy_sequence") <= run)).alias("leftovers"))


def event_epoch(events: DataFrame, now: int) -> DataFrame:
    """The next epoch per round; the clock may have stepped back."""
    return events.groupBy("round").agg(F.greatest(F.lit(now), F.max("create_at") + 1).alias("epoch"))


def commit(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs whose baseline may be published: completed, in order, once per job and sequence."""
    ready = runs.join(finished.select("job_id", "sequence").distinct(), ["job_id", "sequence"], "left_semi").where("phase = 'completed'")
    return ready.groupBy("job_id").agg(F.max("sequence").alias("committed"), F.count(F.lit(1)).alias("runs"))


def latest_run(runs: DataFrame) -> DataFrame:
    return latest_by_key(runs, ["job_id"], "sequence")
