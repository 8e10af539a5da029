"""Totals of contributions by directory."""

from ledgerlake.operators import stats


def test_only_newest_contributions_are_sorted_whole(spark, monkeypatch):
    """A directory without a job or name is one, too; older contributions go by their numbers alone."""
    numbers = [f"{c}_{k}" for c in stats.COUNTERS for k in stats.KINDS] + list(stats.AMOUNTS)
    rows = [(j, d, s, *[n] * len(numbers), "complete", False) for j, d, s, n in ((1, 1, 1, 50), (1, 1, 3, 2), (1, 1, 2, 70), (1, 2, 1, 5), (None, None, 4, 9), (None, None, 8, 11), (2, 7, None, 3))]
    df = spark.createDataFrame(rows, "job long, dir long, seq long, " + ", ".join(f"{x} long" for x in numbers) + ", outcome string, vanished_listing boolean")
    seen, kept = [], stats.latest_by_key
    monkeypatch.setattr(stats, "latest_by_key", lambda given, *a: seen.append(given) or kept(given, *a))
    got = {r.job: (r.scanned_files, r.scanned, r.directories) for r in stats.scan_counts(df, "job").collect()}
    assert got[1] == (7, 21, 2) and got[None] == (11, 33, 1) and got[2][2] == 1
    assert seen[0].count() == 4
