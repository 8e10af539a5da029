"""Streams that keep a state: what they ask of it, and restarts."""

import duckdb
import pytest
from pyspark.sql import Row

from ledgerlake import catalog_queries
from ledgerlake.plans.fixtures import Tables
from ledgerlake.registry import rest
from ledgerlake.shared import shared_folder
from ledgerlake.streaming import streams


class Held:
    """A state variable that counts what is asked of it."""

    def __init__(self, calls):
        self.calls, self.value, self.rows = calls, None, []

    def get(self):
        self.calls.append("get")
        return self.value if self.value else iter(list(self.rows))

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.calls.append("append")
        self.rows += rows


class Cursor(Held):
    def get(self):
        self.calls.append("get")
        return self.value


class Handle:
    def __init__(self, calls):
        self.calls = calls

    def getValueState(self, *_):  # noqa: N802
        return Cursor(self.calls)

    def getListState(self, *_):  # noqa: N802
        return Held(self.calls)


def report(arrival, batch_id, content, sequence, final=False):
    return Row(task=1, arrival=arrival, batch_id=batch_id, content=content, round_at=1, round_id="r", attempt_at=1, attempt_id="a", sequence=sequence, final=final)


def test_a_batch_of_reports_costs_few_state_calls():
    calls = []
    processor = streams.ReportState(1000)
    processor.init(Handle(calls))
    first = [report(i, f"b{i}", "x", i) for i in range(500)]
    got = list(processor.handleInputRows((1,), iter(reversed(first)), None))
    assert [r.arrival for r in got] == list(range(500)) and {r.status for r in got} == {"advanced"}
    second = [report(500, "b3", "x", 900), report(501, "b4", "y", 901), report(502, "n", "x", 2), report(503, None, "x", 902, True), report(504, None, "x", 903), report(505, "n", "z", 999)]
    got = list(processor.handleInputRows((1,), iter(second), None))
    assert [r.status for r in got] == ["duplicate", "conflict", "stale", "advanced", "stale", "conflict"]
    assert len(calls) == 8  # four a micro-batch, however many reports it has


def test_totals_by_replacement_without_python_workers(spark, tmp_path, monkeypatch):
    """A directory's newer contribution replaces its older one, a late older one nothing."""
    where, plans, kept = str(tmp_path / "in"), [], streams.collected
    schema = "dir long, seq long, " + ", ".join(f"{c} long" for c in streams.COUNTERS)
    monkeypatch.setattr(streams, "collected", lambda df, *a: plans.append(df._jdf.queryExecution().logical().toString()) or kept(df, *a))
    for part, want in (([(1, 5, 10), (1, 4, 90), (2, -3, 7)], 17), ([(1, 3, 80), (2, 9, 8), (3, 1, 100)], 118)):
        spark.createDataFrame([(d, s, *[n] * 5) for d, s, n in part], schema).write.mode("append").parquet(where)
        got = streams.running_stats(spark.readStream.schema(schema).parquet(where), str(tmp_path / "out")).collect()
        assert [tuple(r) for r in got] == [(want,) * 5]
    assert plans and not any("Pandas" in p or "Python" in p for p in plans)


def test_equal_sequences_of_a_directory(spark, tmp_path):
    """The greatest whole contribution counts, wherever it comes among its equals, in one batch or later."""
    where, schema = str(tmp_path / "in"), "dir long, seq long, " + ", ".join(f"{c} long" for c in streams.COUNTERS)
    parts = (
        ([(1, 5, 9, 9, 0, 0, 0), (1, 5, 10, 0, 4, 6, 0), (1, 5, 10, 0, 3, 7, 0), (1, 4, 90, 0, 90, 0, 0), (2, None, 4, 0, 4, 0, 0), (2, None, 3, 0, 3, 0, 0)], (14, 0, 8, 6, 0)),
        ([(1, 5, 7, 7, 0, 0, 0), (1, 5, 10, None, 10, 0, 0), (2, None, None, 1, 1, 1, 1)], (14, 0, 8, 6, 0)),
        ([(1, 5, 12, 1, 5, 4, 2), (2, 0, 1, 0, 1, 0, 0)], (13, 1, 6, 4, 2)),
    )
    for part, want in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
        got = streams.running_stats(spark.readStream.schema(schema).parquet(where), str(tmp_path / "out")).collect()
        assert [tuple(r) for r in got] == [want]


LINES = [(1, 5, 2, 90.0), *[(1, 5, 3, q) for q in (3.0, 50.0, 7.0)], *[(2, None, 1, q) for q in (4.0, 9.0, 6.0)], (None, 1, 1, 11.0), *[(3, 19, 1, q) for q in (None, 8.0, None)]]


@pytest.mark.parametrize("lines, want", [(LINES, (78, 6, 69, 2, 1)), (LINES[::-1], (78, 6, 69, 2, 1)), ([], (0, 0, 0, 0, 0))])
def test_str_stats_and_its_sql_settle_ties_alike(spark, tmp_path, lines, want):
    """Lines with one supplier and key, without a key, supplier or quantity, and no lines at all."""
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog_queries.queries()["str_stats"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert [tuple(r) for r in got] == con.sql(catalog_queries.oracle_sql()["str_stats"]).fetchall() == [want]


def test_stage_has_as_many_files_as_the_listing(spark, sf_dir):
    """Four tasks are no bound; each of two batches takes half of the files, however many they are."""
    t = Tables(spark, sf_dir)
    t.made["work_x"] = t("work_x").repartition(9)
    sizes = []
    stream = rest._stage_stream(t).select("k", "_metadata.file_path")
    streams.run_to_end(stream, lambda df, b: sizes.append((df.select("file_path").distinct().count(), df.count())), shared_folder(spark, "halves"))
    assert [files for files, _ in sizes] == [5, 4] and sum(n for _, n in sizes) == t("work_x").count()
    few = []
    t.made["work_x"] = t("work_x").coalesce(1)
    streams.run_to_end(rest._stage_stream(t).select("k"), lambda df, b: few.append(df.count()), shared_folder(spark, "halves"))
    assert len(few) == 2 and sum(few) == sum(n for _, n in sizes)


def test_compared_batches_are_read_once(spark, sf_dir, monkeypatch):
    """No batch is kept in memory, and base rows are the batch's own, in its columns."""
    kept = []
    kind = type(spark.range(1))
    for name in ("persist", "cache"):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name): kept.append(name) or f(self, *a))
    t, where = Tables(spark, sf_dir), shared_folder(spark, "compare")
    events = streams.compare_stream(rest._stage_stream(t), t("base_x"), where)
    base = spark.read.parquet(f"{where}/base").drop("batch")
    assert not kept and base.columns == t("work_x").columns
    assert sorted(map(repr, base.collect())) == sorted(map(repr, t("work_x").collect())) and events.count() == base.count()
