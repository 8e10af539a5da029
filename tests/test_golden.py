"""Golden cases with known answers."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import columns as fn
from ledgerlake.operators import compare, delta, filters, policy, stats, tree, windows
from ledgerlake.plans.fixtures import AS_OF_NS, Tables
from ledgerlake.sources import io


def one(df):
    return df.collect()[0].asDict()


ENTRY = "relative_path string, size long, is_dir boolean, is_symlink boolean, entry_kind string, size_observed boolean, mtime_ns long"


def seeded_tree(seed):
    """Entries of a random forest: names that begin alike, characters of all kinds, some sizes not observed."""
    rng = random.Random(seed)
    names = ["a", "ab", "a b", "ü", "日", "x.tar", "A"]
    rows = {}
    for _ in range(rng.randint(20, 120)):
        path = "/".join(rng.choice(names) for _ in range(rng.randint(1, 5)))
        if not any(p == path or p.startswith(path + "/") or path.startswith(p + "/") and r[0] != "directory" for p, r in rows.items()):
            rows[path] = (rng.choice(("file", "file", "file", "directory", "symlink")), rng.randrange(5000), rng.random() < 0.9, rng.randrange(10**6))
    return rows


def rolled_up(rows, prefix):
    """Direct children of a prefix: kind, bytes, files, directories below, newest time."""
    out = {}
    for path, (kind, size, seen, at) in rows.items():
        if kind == "symlink" or not path.startswith(prefix) or path == prefix:
            continue
        first, _, deeper = path[len(prefix) :].partition("/")
        c = out.setdefault(prefix + first, ["file", 0, 0, 0, None])
        c[0] = "directory" if deeper or kind == "directory" else c[0]
        c[1] += size if kind == "file" and seen else 0
        c[2] += kind == "file"
        c[3] += kind == "directory" and bool(deeper)
        c[4] = max(filter(None, (c[4], at if seen else None)), default=None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tree_of_a_seed(spark, seed):
    rows = seeded_tree(seed)
    df = spark.createDataFrame([(p, s, k == "directory", k == "symlink", k, seen, t) for p, (k, s, seen, t) in rows.items()], ENTRY)
    for prefix in ["", *sorted({p.rsplit("/", 1)[0] + "/" for p in rows if "/" in p})[:4]]:
        level = tree.children(df, prefix)
        want = rolled_up(rows, prefix)
        assert {r.path: [r.kind, r.bytes, r.file_count, r.directory_count, r.mtime_ns] for r in level.collect()} == want
        for metric, k in (("bytes", 1), ("file_count", 2)):
            out = tree.top_with_other(level, 3, metric).collect()
            order = sorted(want, key=lambda p: (-want[p][k], p, want[p][0]))  # noqa: B023
            assert [r.path for r in sorted(out, key=lambda r: r.rank)] == order[:3] + [""] * (len(want) > 3)
            assert sum(r.bytes for r in out) == sum(w[1] for w in want.values()) and sum(r.file_count for r in out) == sum(w[2] for w in want.values())
    totals = {r.path: (r.bytes, r.file_count) for r in tree.all_directories(df).collect()}
    files = {p: (s if seen else 0) for p, (k, s, seen, _) in rows.items() if k == "file"}
    above = {"", *(p.rsplit("/", i)[0] for p in files for i in range(1, p.count("/") + 1))} if files else set()
    assert totals == {d: (sum(s for p, s in files.items() if not d or p.startswith(d + "/")), sum(not d or p.startswith(d + "/") for p in files)) for d in above}


def test_renames_over_versions_and_logged_decisions(spark):
    key = "relative_path string, version_id string, file_handle string"
    old = spark.createDataFrame([("a", "v1", "h1"), ("a", "v2", "h2"), ("s", "v1", "h3"), ("t", "v1", "h4"), ("t2", "v1", "h4"), ("keep", "", "h5"), ("w", "", "h6")], key)
    live = spark.createDataFrame([("b", "v1", "h1"), ("s", "v1", "h9"), ("moved", "v1", "h3"), ("u", "v1", "h4"), ("keep", "", "h5"), ("w1", "", "h6"), ("w2", "", "h6"), ("n", "", None), ("back", "", "h7"), ("late", "", "h8"), ("c", "", "h10")], key)
    log = spark.createDataFrame([("deleted", "was", "", "h7", None), ("rename", "late", "", "h8", "early"), ("new", "b", "v1", "h1", None)], "operation_type string, " + key + ", comment string")
    got = lambda df: {(r.relative_path, r.version_id, r.outcome): (r.from_path, r.from_version) for r in df.collect()}
    plain = got(compare.final_renames(old, live))
    none = (None, None)
    common = {("a", "v2", "deleted"): none, ("s", "v1", "new"): none, ("moved", "v1", "rename"): ("s", "v1"), ("u", "v1", "new"): none, ("t", "v1", "deleted"): none, ("t2", "v1", "deleted"): none, ("w1", "", "new"): none, ("w2", "", "new"): none, ("w", "", "deleted"): none, ("n", "", "new"): none, ("c", "", "new"): none}
    assert plain == common | {("b", "v1", "rename"): ("a", "v1"), ("back", "", "new"): none, ("late", "", "new"): none}
    logged = got(compare.final_renames(old, live, log))
    assert logged == common | {("b", "v1", "new"): none, ("a", "v1", "deleted"): none, ("back", "", "rename"): ("was", ""), ("late", "", "rename"): ("early", "")}


def test_history_rules(spark):
    def codes(*rows):
        df = spark.createDataFrame([("p", f"v{i}", *r) for i, r in enumerate(rows)], "relative_path string, version_id string, history_segment long, history_index long, history_records long, history_complete boolean, is_latest boolean")
        return [r.violation for r in windows.history_violations(df).orderBy("version_id").collect()]

    assert codes((0, 0, 2, False, False), (0, 1, 2, False, False), (1, 0, 1, True, True)) == []
    assert codes((0, 1, 2, True, True)) == ["first_index"] and codes((1, 0, 1, True, True)) == ["first_index"]
    assert codes((0, 0, 2, False, False), (1, 0, 1, True, True)) == ["segment"]
    assert codes((0, 0, 1, True, False), (1, 0, 1, True, True)) == ["segment"]
    assert codes((0, 0, 3, True, False), (0, 2, 3, True, True)) == ["gap"]
    assert codes((0, 0, 2, True, False), (0, 1, 3, True, False)) == ["boundary"]
    assert codes((0, 0, 2, True, True), (0, 1, 2, True, False)) == ["latest_early", "after_latest"]
    assert codes((0, 0, 1, True, False)) == ["latest_not_last"]


def test_ranges_over_slots(spark):
    rng = random.Random(7)
    raw = [(a, a + rng.choice([1, 5, 40, 300])) for a in (rng.randrange(3000) for _ in range(80))]
    want = []
    for a, z in sorted(raw):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], z)
        else:
            want.append([a, z])
    for slot in (10, 100, 10**6):
        got = windows.interval_union(spark.createDataFrame(raw, "start_off long, end_off long"), None, slot)
        assert sorted([r.start_off, r.end_off] for r in got.collect()) == want


def test_places_and_digests(spark):
    rows = [(i * 37 % 101, str(i)) for i in range(101)]
    got = {r.a: r.place for r in windows.places(spark.createDataFrame(rows, "a long, b string"), F.desc("a")).collect()}
    assert got == {a: 101 - a for a in range(101)}
    tags = spark.createDataFrame([({"a": None, "b": "1"},), ({"b": "1"},), ({"a": "", "b": "1"},), ({"b": "1", "a": None},)], "t map<string,string>")
    d = [r[0] for r in tags.select(fn.metadata_digest(F.col("t"), F.lit("ok"))).collect()]
    assert d[0] == d[3] and len(set(d)) == 3


def test_statistics(spark):
    rows = [("a.TXT", 1, "TXT"), ("b.txt", 4096, "txt"), ("no-extension", 65536, None)]
    data = [(p, s, e, False, False, True, 0) for p, s, e in rows] + [("nested/dir", 1024, None, True, False, False, 0), ("link", 0, None, False, True, False, 0)]
    df = spark.createDataFrame(data, "relative_path string, size long, ext string, is_dir boolean, is_symlink boolean, is_regular_file boolean, mtime_ns long")
    s = one(stats.summary_counts(df))
    assert (s["files"], s["file_bytes"], s["dirs"], s["dir_bytes"], s["links"], s["link_bytes"]) == (3, 69633, 1, 1024, 1, 0)
    assert (s["total_depth"], s["max_depth"], s["total_name"], s["max_name"]) == (2, 2, 29 - 0, 12)
    assert [tuple(r) for r in stats.by_extension(df).collect()] == [("txt", 4097, 2)]
    assert [tuple(r) for r in stats.by_age(df, AS_OF_NS).collect()] == [(5, 70657, 5)]
    assert sorted(tuple(r) for r in stats.by_size(df).collect()) == [(0, 1, 1), (1, 4096, 1), (2, 65536, 1)]
    empty = one(stats.summary_counts(df.limit(0)))
    assert set(empty.values()) == {0} and stats.single_pass(df.limit(0), AS_OF_NS).where("part <> 'total'").count() == 0


def test_every_bucket(spark):
    sizes = [0, 4096, 65536, 131072, 262144, 524288, 1048576, 2097152, 16777216, 67108864, 134217728, 536870912]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "size long").select(fn.size_bucket("size")).collect()] == list(range(12))
    days = spark.createDataFrame([(AS_OF_NS - d * fn.DAY_NS,) for d in (-2, 0, 3, 14, 90, 270, 730)], "m long")
    assert [r[0] for r in days.select(fn.age_bucket("m", AS_OF_NS)).collect()] == [0, 0, 1, 2, 3, 4, 5]


def test_history(spark):
    v = spark.createDataFrame([("p", f"v{i}", i, 20, i == 19, i + 1) for i in range(20)] + [("q", "old", 0, 2, False, 8 << 20), ("q", "new", 1, 2, True, 1)], "relative_path string, version_id string, history_index int, history_records int, is_latest boolean, size long")
    every = {r.relative_path: r for r in stats.history_inventory(v).collect()}
    assert every["p"].bytes == 210 and every["q"].bytes == 8388609 and every["q"].distribution_size == 8 << 20
    latest = {r.relative_path: r for r in stats.history_inventory(v, latest_only=True).collect()}
    assert latest["q"].bytes == 1 and latest["q"].distribution_size == 1


def test_deleted_renamed_ambiguous(spark):
    old = spark.createDataFrame([("a", "", "h1", "file"), ("b", "", "h2", "file"), ("c", "", "h3", "file"), ("d", "", None, "file")], "relative_path string, version_id string, file_handle string, entry_kind string")
    new = spark.createDataFrame([("b2", "", "h2", "file"), ("c2", "", "h3", "file"), ("c3", "", "h3", "file"), ("n", "", None, "file")], old.schema)
    got = {r.relative_path: (r.status, r.to_path) for r in compare.delete_or_rename(old, new).collect()}
    assert got == {"a": ("deleted", None), "b": ("renamed", "b2"), "c": ("ambiguous", None), "d": ("deleted", None)}


def test_redaction(spark):
    texts = ["failed (s3://alice:secret@host/path?token=value), password=hunter token abc", "界" * 2000, "error password = hunter", "Authorization: Bearer abcdef", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.redact("t")).collect()]
    assert not any(w in got[0] for w in ("alice", "hunter", "abc", "value")) and len(got[1].encode()) <= 2048 and got[1] == "界" * 682
    assert got[2] == "error [redacted]" and got[3] == "[redacted]" and got[4] is None and got[5] == ""


def test_tree_paths():
    for path, limit in (("/etc", 1), ("../etc", 1), ("a/../b", 1), ("a/./b", 1), ("a\nb", 1), ("a", 0), ("a", 501), ("x" * 5000, 1)):
        with pytest.raises(ValueError):
            filters.safe_tree_path(path, limit)
    assert filters.safe_tree_path("reports/2026/") == ("reports/2026", 120)


@pytest.mark.parametrize("glob,path,hit", [("*.txt", "a.txt", True), ("*.txt", "a/b.txt", False), ("?[!x]c", "abc", True), ("?[!x]c", "axc", False), ("a[]]b", "a]b", True), ("a[?]b", "a?b", True), ("a[?]b", "axb", False)])
def test_name_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(fn.glob_to_regex(glob))).head()[0] is hit


@pytest.mark.parametrize("glob,path,hit", [("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**", "a/b/c", True), ("a/*/c", "a/b/c", True), ("a/*", "a/b/c", False), ("a/**/c", "a/c", True)])
def test_path_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(fn.glob_to_regex(glob, True))).head()[0] is hit


@pytest.mark.parametrize("glob", ["**a", "***", "a[b", "x/**y/z"])
def test_bad_globs(glob):
    with pytest.raises(ValueError):
        fn.glob_to_regex(glob, True)


def test_intervals(spark):
    r = spark.createDataFrame([(1, 10, 20), (1, 20, 30), (1, 25, 26), (1, 50, 60), (1, 5, 5), (1, 9, 3)], "file_id long, start_off long, end_off long")
    merged = windows.interval_union(r)
    assert sorted((x.start_off, x.end_off) for x in merged.collect()) == [(10, 30), (50, 60)]
    total = spark.createDataFrame([(1, 55)], "file_id long, total long")
    assert sorted((x.gap_start, x.gap_end) for x in windows.interval_missing(merged, total).collect()) == [(0, 10), (30, 50)]


def test_generation_policy(spark):
    base = dict(execution_id="e", phase="completed", baseline_prepared=True, retains_source=True, binding="b", contract="c", selection_key="s", filtered=False, relative_time=False, delete_target=False, baseline_available=True)
    runs = [base | dict(job_id=j, sequence=1) for j in range(1, 6)]
    runs += [base | dict(job_id=1, sequence=2, delete_target=True), base | dict(job_id=2, sequence=2, contract="c2"), base | dict(job_id=3, sequence=2, binding="other"), base | dict(job_id=4, sequence=2, filtered=True, delete_target=True), base | dict(job_id=5, sequence=2, baseline_available=False)]
    got = {(r.job_id, r.sequence): r for r in policy.plan(spark.createDataFrame(runs)).collect()}
    assert got[1, 1].mode == "full" and got[1, 1].reasons == "first_generation"
    assert (got[1, 2].mode, got[1, 2].target_policy, got[1, 2].error) == ("incremental", "confirm_absent_within_scope", None)
    assert got[2, 2].force_copy and got[2, 2].reasons == "retained_source_facts,contract_changed"
    assert got[3, 2].error == "binding_changed" and got[4, 2].error == "target_cleanup_conflict"
    assert got[5, 2].mode == "full" and got[5, 2].reasons == "baseline_unavailable"


def test_golden_classes_partition_the_stage(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    assert (t("base").count(), t("work").count(), t("versions").count()) == (14700, 14594, 59405)
    merged = windows.interval_union(t("ranges").join(t("ranges").select("file_id").distinct().orderBy("file_id").limit(5), "file_id", "left_semi"))
    want = defaultdict(set)
    for r in t("ranges").collect():
        want[r.file_id] |= set(range(r.start_off, r.end_off))
    assert {r.file_id: r.b for r in merged.groupBy("file_id").agg(F.sum(F.col("end_off") - F.col("start_off")).alias("b")).collect()} == {f: len(want[f]) for f in sorted(want)[:5]}
    sizes = {r.bucket: (r.entries, r.bytes) for r in stats.by_size(t("work").withColumn("is_regular_file", F.lit(True))).collect()}
    assert sizes[0] == (1860, 3832822) and sizes[11] == (1701, 1328612726946)
    history = one(stats.history_inventory(t("versions")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.sum("distribution_size").alias("d")))
    assert history == {"n": 14743, "b": 315092185858, "d": 118916632362}
    assert compare.classify(t("work_x"), t("base_x")).count() == 14594


def test_events_replay_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "new", "a", "", 0), (1, "new", "b", "", 0), (1, "new", "b", "", 0)], "round long, op string, path string, version_id string, create_at long")
    seen = []
    for _ in range(3):
        io.append_events(spark, str(tmp_path / "events"), rows)
        seen.append(sorted((r.path, r.create_at) for r in spark.read.parquet(str(tmp_path / "events")).collect()))
    assert seen[0] == seen[1] == seen[2] and [p for p, _ in seen[0]] == ["a", "b"] and sorted(n for _, n in seen[0]) == [1, 2]


def test_publish_leaves_other_jobs(spark, tmp_path):
    where = str(tmp_path / "c")
    io.publish(spark.createDataFrame([("a", 1), ("b", 2)], "relative_path string, job_id long"), where)
    io.publish(spark.createDataFrame([("z", 1)], "relative_path string, job_id long"), where)
    assert sorted((r.relative_path, r.job_id) for r in spark.read.parquet(where).collect()) == [("b", 2), ("z", 1)]


def test_listing_a_directory(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.tar.gz").write_bytes(b"12345")
    got = io.list_directory(spark, str(tmp_path)).collect()
    assert [(r.name, r.ext, r["size"]) for r in got] == [("a.tar.gz", "gz", 5)]


def test_no_python_or_cross_join_in_comparison_plans(spark, sf_dir):
    t = Tables(spark, sf_dir)
    plan = compare.classify(t("work_x"), t("base_x"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan
