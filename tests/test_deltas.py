"""Duplicate blocks and deltas at any offset against matchers of whole files."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake import catalog_queries
from ledgerlake.operators import delta
from ledgerlake.plans.fixtures import Tables
from ledgerlake.registry.stats import pairs as file_pairs


def tokens_of(old: bytes, new: bytes, size: int) -> list[tuple[int, bytes | None]]:
    """Match tokens (block, None) and data tokens (-1, bytes); blocks are found at any offset.

    Windows whose weak hash no block has are passed over at once; the others are compared."""
    whole = len(old) // size
    tail = old[whole * size :]
    where: dict[int, list[int]] = {}
    if whole:
        every = delta.weak_hashes(np.frombuffer(old, np.uint8), size)[::size][:whole]
        for k, h in enumerate(every.tolist()):
            where.setdefault(h, []).append(k)
    found: list[tuple[int, int, int]] = []
    at = 0
    if whole and len(new) >= size:
        weak = delta.weak_hashes(np.frombuffer(new, np.uint8), size)
        hits = np.flatnonzero(np.isin(weak, list(where)))
        i = 0
        while i < len(hits):
            here = int(hits[i])
            part = new[here : here + size]
            same = [k for k in where[int(weak[here])] if old[k * size : (k + 1) * size] == part]
            if same:
                # A block at its own place is preferred to a moved one.
                found.append((here, size, here // size if here % size == 0 and here // size in same else same[0]))
                at = here + size
                i = int(np.searchsorted(hits, at))
            else:
                i += 1
    if tail and len(new) - len(tail) >= at and new.endswith(tail):
        found.append((len(new) - len(tail), len(tail), whole))
    out: list[tuple[int, bytes | None]] = []
    at = 0
    for here, width, k in found:
        if at < here:
            out.append((-1, new[at:here]))
        out.append((k, None))
        at = here + width
    return [*out, (-1, new[at:])] if at < len(new) else out


def size_of(old):
    return max(700, min(131072, int(len(old) ** 0.5)))


def totals(old, new):
    plan = tokens_of(old, new, size_of(old))
    assert b"".join(d if k < 0 else old[k * size_of(old) : (k + 1) * size_of(old)] for k, d in plan) == new
    return sum(k >= 0 for k, _ in plan), sum(len(d) for k, d in plan if k < 0), len(new)


def places(old, new):
    """Whole blocks only: place and block, left to right."""
    at, out = 0, []
    for k, d in tokens_of(old, new, size_of(old)):
        if k >= 0 and k < len(old) // size_of(old):
            out.append((at, k))
        at += len(d) if k < 0 else len(old[k * size_of(old) : (k + 1) * size_of(old)])
    return out


def edited(rng):
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a = say(9000)
    parts = [a[i : i + 700] for i in range(0, 9000, 700)]
    shuffled = parts[:]
    rng.shuffle(shuffled)
    rep = say(7) * 900
    return [(None, None), ("", ""), ("", a), (a, ""), (a, None), (a, a), (a, "x" + a), (a, a[:3000] + "inserted" + a[3000:]), (a, "".join(shuffled)), (a, "".join(shuffled + parts[:3])), (rep, "y" + rep + rep), ("z" * 5000, "z" * 7777), ("z" * 5000, "q" + "z" * 4000 + "q" + "z" * 3000), (a[:699], a[:699]), (a[:1400], "t" + a[:1400]), (a, a[5:] + a[:5])]


@pytest.mark.parametrize("span", [700, 1000, 1 << 20])
def test_blocks_at_any_offset(spark, monkeypatch, span):
    monkeypatch.setattr(delta, "RANGE_BYTES", span)
    cases = edited(random.Random(span))
    df = spark.createDataFrame([(i, o, n, "clash") for i, (o, n) in enumerate(cases)], "doc_id long, old string, new string, size string").repartition(3)
    raw = [((o or "").encode(), (n or "").encode()) for o, n in cases]
    got = {r.key: [] for r in df.select(F.col("doc_id").alias("key")).collect()}
    for r in delta.shifted_tokens(df, "doc_id").collect():
        got[r.key].append((r.place, r.block))
    for i, (o, n) in enumerate(raw):
        assert sorted(got[i]) == places(o, n), i
    plan = {r.doc_id: (r.matched_blocks, r.literal_bytes, r.total_bytes) for r in delta.shifted_plan(df, "doc_id").collect()}
    assert plan == {i: totals(o, n) for i, (o, n) in enumerate(raw)}
    assert delta.shifted_plan(df.limit(0), "doc_id").count() == 0


def test_a_file_is_many_rows(spark, monkeypatch):
    monkeypatch.setattr(delta, "RANGE_BYTES", 1000)
    df = spark.createDataFrame([(1, "a" * 20_000, "b" * 50_000)], "key long, old string, new string").withColumn("size", F.lit(700).cast("long"))
    rows = delta._ranged(df, "key", "new").select("r", F.octet_length("part").alias("n")).collect()
    assert len(rows) == 50 and max(r.n for r in rows) == 1699


def test_wrong_hashes_are_struck_out(spark):
    """Blocks of one weak hash, and a second hash that tells nothing apart: SHA-256 decides."""
    rng = random.Random(6)
    base = [rng.randrange(97, 110) for _ in range(6000)]
    forged = base[:]
    for i in range(10, 5000, 350):  # keeps both sums of the weak hash
        forged[i], forged[i + 1], forged[i + 2] = forged[i] + 1, forged[i + 1] - 2, forged[i + 2] + 1
    old, new = bytes(base).decode(), "shift" + bytes(forged).decode() + bytes(base[700:1400]).decode()
    df = spark.createDataFrame([(1, old, new)], "key long, old string, new string")
    got = delta.shifted_tokens(df, "key", second=lambda data, width: np.zeros(len(data) - width + 1, np.int64)).collect()
    assert sorted((r.place, r.block) for r in got) == places(old.encode(), new.encode()) != []


def test_wrong_hashes_are_struck_out_of_ranges(spark, monkeypatch):
    """As above where files are cut into ranges."""
    monkeypatch.setattr(delta, "RANGE_BYTES", 1000)
    test_wrong_hashes_are_struck_out(spark)


def test_small_pairs_are_matched_where_they_lie(spark, monkeypatch):
    """No range is made of them and no text is joined: the plan's one join has numbers on both sides."""
    cut = []
    monkeypatch.setattr(delta, "_ranged", lambda pairs, *_: cut.append(pairs) or pairs.crash)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    cases = [(i, o, "x" + o + say(rng.randrange(900))) for i, o in enumerate(say(rng.randrange(9000)) for _ in range(40))]
    plan = delta.shifted_plan(spark.createDataFrame(cases, "doc_id long, old string, new string").repartition(3), "doc_id")
    assert {r.doc_id: (r.matched_blocks, r.literal_bytes, r.total_bytes) for r in plan.collect()} == {i: totals(o.encode(), n.encode()) for i, o, n in cases}
    joins = []

    def walk(node):
        if node.nodeName() == "Join":
            joins.append(node)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan._jdf.queryExecution().optimizedPlan())
    assert len(joins) == 1 and not cut
    assert not [f.dataType().typeName() for j in joins for f in j.schema().fields() if f.dataType().typeName() in ("string", "binary")]


def test_query_over_whole_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old, new = ({r.doc_id: (r.content or "").encode() for r in df.collect()} for df in file_pairs(t))
    got = {r.doc_id: (r.matched_blocks, r.literal_bytes, r.total_bytes) for r in catalog_queries.queries()["agg_delta_plan_shifted"](spark, sf_dir).collect()}
    assert got == {d: totals(old[d], new[d]) for d in old}


def test_strong_hashes_for_candidates_only(spark):
    """Forced weak collisions are told apart; a block whose weak hash is alone has no strong hash."""
    rng = random.Random(7)
    block = lambda: [rng.randrange(97, 120) for _ in range(700)]
    a, b = block(), block()
    forged = a[:]
    forged[3], forged[4], forged[5] = a[3] + 1, a[4] - 2, a[5] + 1
    files = [(1, bytes(a + b).decode()), (2, bytes(forged + a).decode()), (3, bytes(block()).decode()), (4, ""), (5, None), (6, "tail"), (7, "tail")]
    df = spark.createDataFrame(files, "doc_id long, content string").repartition(3)
    cut = [t.encode()[i : i + 700] for _, t in files if t for i in range(0, len(t), 700)]
    want = Counter(hashlib.sha256(c).hexdigest() for c in cut)
    got = delta.block_dedup(df, ["doc_id"]).collect()[0]
    assert (got.blocks, got.distinct_blocks, got.bytes, got.distinct_bytes) == (len(cut), len(want), sum(map(len, cut)), sum(map(len, set(cut))))
    weak = delta.weak_blocks(df, ["doc_id"])
    shared = weak.groupBy("bytes", "weak").count().where("count > 1")
    again = delta.candidates(df, weak.join(shared, ["bytes", "weak"], "left_semi"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r["index"]) for r in again) == [(1, 0), (2, 0), (2, 1), (6, 0), (7, 0)]


def test_weak_hash_of_large_blocks(spark):
    from ledgerlake.functions import columns as fn

    texts = ["", None, "a", "é" * 70_000, "xyz" * 100_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", fn.weak_hash("t").alias("w")).collect()
    for r in got:
        data = (texts[r.i] or "").encode()
        a, b = sum(data) % 65521, sum((len(data) - j) * v for j, v in enumerate(data)) % 65521
        assert r.w == (None if texts[r.i] is None else b << 16 | a)
