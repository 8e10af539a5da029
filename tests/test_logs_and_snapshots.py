"""Log sweeps, contained paths, line numbers, ranges of hot files, snapshots and cleared jobs."""

import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlake import catalog_queries
from ledgerlake.operators import logs, windows
from ledgerlake.sources import io


def test_windows_carried_over_partitions(spark):
    """One window spans most of the sorted partitions; lines of one moment lie in several."""
    rng = random.Random(1)
    shown = [(100, 100), (200, 8000), (8500, 8510), (20_000, 20_001)]
    lines = [(i, rng.choice((rng.randrange(9000), 5000, 99, 100, 101, 8510, 8511, 20_002)), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(lines, "line long, at_us long, path string").repartition(5)
    got = windows.in_windows(df, spark.createDataFrame(shown, "start_off long, end_off long"))
    assert got.columns == ["line", "at_us", "path", "start_off", "end_off"]
    want = sorted((n, at, p, a, z) for n, at, p in lines for a, z in shown if a <= at <= z)
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "start_off" not in "".join(x for x in plan.splitlines() if "Join" in x)
    assert windows.in_windows(df, spark.createDataFrame([], "start_off long, end_off long")).count() == 0


def test_a_hot_file_is_spread_over_slots(spark):
    rng = random.Random(2)
    raw = [(rng.choice((1, 1, 1, 2, 3)), a, a + rng.choice((0, 3, 20, 700))) for a in (rng.randrange(20_000) for _ in range(1500))]
    covered = defaultdict(set)
    for f, a, z in raw:
        covered[f] |= set(range(a, z))
    df = spark.createDataFrame(raw, "file_id long, start_off long, end_off long")
    total = spark.createDataFrame([(f, 21_000) for f in (1, 2, 3, 4)], "file_id long, total long")
    for slot in (64, 1000, 1 << 30):
        merged = windows.interval_union(df, slot=slot)
        spans = defaultdict(list)
        for r in merged.collect():
            spans[r.file_id].append((r.start_off, r.end_off))
        for f, s in spans.items():
            s.sort()
            assert all(z < a for (_, z), (a, _) in zip(s, s[1:])) and set().union(*(range(a, z) for a, z in s)) == covered[f]
        gaps = defaultdict(set)
        for r in windows.interval_missing(merged, total, slot=slot).collect():
            gaps[r.file_id] |= set(range(r.gap_start, r.gap_end))
        assert {f: set(range(21_000)) - covered[f] for f in (1, 2, 3, 4)} == dict(gaps)


@pytest.mark.parametrize("name", ["win_interval_union", "win_interval_missing", "win_interval_covers"])
def test_sql_of_intervals_with_many_equal_ranges(name):
    """Equal ranges, in whatever order each window of the SQL puts them, are one range."""
    con = duckdb.connect()
    con.sql("create table lineitem as select f as l_suppkey, 1 as l_linenumber, o as l_orderkey, q as l_quantity from range(20) a(f), range(40) b(o), range(300) c(i), (values (3), (24)) d(q) where (o + f) % 3 > 0")
    got = sorted(con.sql(catalog_queries.oracle_sql()[name]).fetchall())
    kept = {f: [1000 + o * 250 for o in range(40) if (o + f) % 3] for f in range(20)}
    merged = {f: [(a, a + 240) for a in s] for f, s in kept.items()}
    gaps = {f: [(z, a) for (_, z), (a, _) in zip([(0, 0), *m], [*m, (16000, 16000)])] for f, m in merged.items()}
    want = {"win_interval_union": [(f, *x) for f in merged for x in merged[f]], "win_interval_missing": [(f, *x) for f in gaps for x in gaps[f]], "win_interval_covers": [(f, sum(z - a for a, z in g), False) for f, g in gaps.items()]}
    assert got == sorted(want[name])


PATHS = ["a b/c.txt", "x/y", "x/y/z", "p/7/1", "p/7", "ü/ß", "q", "no/such/path", "a.*b", "x" * 400, "p/7/1;"]
TEXTS = ["copied a b/c.txt again", "path=x/y done", "path=p/7/1;", "p/7/12", "p/7", None, "", "ü/ß!", "qq", "a.b a.*b", "x" * 401, "nothing here", "x/y/z"]


@pytest.mark.parametrize("least", [1 << 20, 0])
def test_contained_paths(spark, monkeypatch, least):
    """Blanks, glued text, prefixes of each other; by automaton and by rarest grams."""
    monkeypatch.setattr(logs, "PATTERN_BYTES", least)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("xy/pq7 ") for _ in range(rng.randrange(40))) for _ in range(200)]
    patterns = PATHS + ["".join(rng.choice("xy/pq7 ") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = logs.containing(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), spark.createDataFrame([(p,) for p in patterns + patterns[:5] + ["", None]], "pattern string"))
    rows = [tuple(r) for r in got.select("id", "pattern").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i, p) for i, t in enumerate(texts) for p in patterns if t and p in t}
    assert logs.containing(spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "pattern string")).count() == 0


def test_trace_chain_of_contained_paths(spark):
    rows = [(1, 0, "ERROR", 'CopyEntry failed "a b/c.txt": io', [None]), (2, 10, "INFO", "copied a b/c.txt again", []), (3, 20, "INFO", "path=x/y done", ["k"]), (4, 30, "ERROR", "bad", ["x/y"]),
            (5, 10**9, "ERROR", "alone", ["gone"]), (6, 10**9 + 5, "INFO", "near it", ["other"]), (7, 3 * 10**9, "INFO", "far from it", [])]
    df = spark.createDataFrame([(n, at, lv, m, [(p,) for p in ps]) for n, at, lv, m, ps in rows], "line long, at_us long, level string, message string, spans array<struct<path:string>>")
    got = {tuple(r) for r in logs.trace_chain(df, 1000).select("line", "error_path", "why").collect()}
    assert got == {(1, "a b/c.txt", "trace"), (2, "a b/c.txt", "trace"), (3, "x/y", "trace"), (4, "x/y", "trace"), (5, "gone", "trace"), (6, "gone", "window")}


def chained(rows, margin):
    """Every line against every failed path."""
    failed = {(at, p) for _, at, lv, m, ps in rows if lv == "ERROR" for p in [*ps, *m.split('"')[1:2]] if p}
    bad = {p for _, p in failed}
    traces = {(n, p, lv) for n, _, lv, m, ps in rows for p in bad if p in ps or p in m}
    found = {(n, p) for n, p, _ in traces}
    alone = bad - {p for n, p, _ in traces if any(r[0] == n and r[2] not in ("ERROR", None) for r in rows)}
    near = {(n, p) for n, at, *_ in rows for t, p in failed if p in alone and abs(at - t) <= margin}
    return {(*x, "trace") for x in found} | {(*x, "window") for x in near - found}


@pytest.mark.parametrize("repeats", [0, 40])
def test_windows_that_overlap(spark, repeats):
    """Errors of one path close together, at the ends of slots and before 0; lines of one number."""
    rng = random.Random(repeats)
    at = lambda: rng.choice((rng.randrange(-9000, 9000), 200 * rng.randrange(-30, 30) + rng.choice((-1, 0, 1))))
    rows = []
    for n in range(700):
        level, path = rng.choice(("ERROR", "INFO", "INFO", None)), f"p/{rng.randrange(40)}x"
        rows.append((n, at(), level, f'failed "lost/{n % 9}": io' if level == "ERROR" and n % 3 else "text " + path, [path if level != "ERROR" or n % 5 else f"gone/{n % 4}"]))
    rows += [(rng.randrange(100), at(), rng.choice(("ERROR", "INFO")), "again lost/3", ["gone/1"][: rng.randrange(2)]) for _ in range(repeats)]
    df = spark.createDataFrame([(n, t, lv, m, [(p,) for p in ps]) for n, t, lv, m, ps in rows], "line long, at_us long, level string, message string, spans array<struct<path:string>>").repartition(3)
    got = [tuple(r) for r in logs.trace_chain(df, 100).select("line", "error_path", "why").collect()]
    assert len(got) == len(set(got)) and set(got) == chained(rows, 100)


def test_window_pairs_are_not_shuffled(spark):
    """Pairs of a line and a lone path grow with the square of the lines a minute: nothing is
    exchanged, grouped or joined above the join that makes them."""
    rows = [(n, n, "ERROR" if n % 2 else "INFO", "m", [f"gone/{n}"] if n % 2 else []) for n in range(400)]
    df = spark.createDataFrame([(n, at, lv, m, [(p,) for p in ps]) for n, at, lv, m, ps in rows], "line long, at_us long, level string, message string, spans array<struct<path:string>>")
    out = logs.trace_chain(df, 1000)
    assert out.count() == 400 * 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_grams_of_no_pattern_are_dropped(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('g', id) as gram")
    kept = logs._among(rows, rows.where("id % 100 = 0"), "gram")
    assert kept.columns == ["id", "gram"] and kept.where("id % 100 = 0").count() == 200 and kept.count() < 300
    assert logs._among(rows, rows.limit(0), "gram").count() == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(4)
    want = {}
    for name in ("a.log", "b.log", "c.log"):
        text = ["" if i % 11 == 0 else f"{name} {i} " + "é" * rng.randrange(60) for i in range(rng.randrange(2000, 4000))]
        (tmp_path / name).write_text("\n".join(text) + "\n")
        want |= {(name, i): t for i, t in enumerate(text, 1)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = io.numbered_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == want


def test_readers_stay_on_the_old_snapshot(spark, tmp_path):
    """A round that dies after half of its partitions, and one that dies before its run rows."""
    root = str(tmp_path / "c")
    rows = lambda size, jobs=(1, 2): spark.createDataFrame([(f"p{i}", j, size) for i in range(5) for j in jobs], "relative_path string, job_id long, size long")
    sizes = lambda: {(r.job_id, r["size"]): r["count"] for r in io.committed(spark, root).groupBy("job_id", "size").count().collect()}
    io.commit_round(rows(1), root, "r1", 1)
    assert sizes() == {(1, 1): 5, (2, 1): 5}
    io.write_snapshot(rows(2, (1,)), root, "r2")
    assert sizes() == {(1, 1): 5, (2, 1): 5}
    io.write_snapshot(rows(2), root, "r2")
    assert sizes() == {(1, 1): 5, (2, 1): 5}
    for _ in range(2):  # and its replay
        io.commit_round(rows(2), root, "r2", 2)
        assert sizes() == {(1, 2): 5, (2, 2): 5} and spark.read.parquet(f"{root}/runs").count() == 4
    io.commit_round(rows(3, (2,)), root, "r3", 3)
    assert sizes() == {(1, 2): 5, (2, 3): 5}
    io.commit_round(rows(4), root, "r4", 4)
    io.commit_round(rows(5), root, "r5", 5)
    assert io.vacuum(spark, root) == 3 and sizes() == {(1, 5): 5, (2, 5): 5}


def test_cleared_job_leaves_other_files(spark, tmp_path):
    tables = [str(tmp_path / n) for n in ("one", "two")]
    for where in tables:
        io.publish(spark.createDataFrame([(f"p{i}", i % 3) for i in range(30)], "relative_path string, job_id long"), where)
    listed = lambda: {(str(d), f, os.stat(f"{d}/{f}").st_mtime_ns) for where in tables for d, _, fs in os.walk(where) for f in fs if "job_id=1" not in d and f.startswith("part-")}
    before = listed()
    assert io.clear_job(spark, tables, 1) == 2 and io.clear_job(spark, tables, 1) == 0
    assert listed() == before and before
    for where in tables:
        assert spark.read.parquet(where).where(F.col("job_id") == 1).count() == 0 and spark.read.parquet(where).count() == 20
