"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ledgerlake.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k=50):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    N, L = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    queries_ = defaultdict(set)
    for i, t in items:
        queries_[i] |= set(terms(t))
    out = Counter()
    for item, wanted in queries_.items():
        scored = []
        for (d, c), n in zip(counts, sizes):
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * N // L))) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, null, d) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if null else d, -score] += 1
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)] + ["É", "日本", "Zero0"]
    weights = [1 / (i + 1) for i in range(len(words))]
    say = lambda n: " ".join(rng.choices(words, weights, k=n))
    out = [(i, say(rng.choice((1, 5, 40, 200)))) for i in range(900)]
    out += [(None, say(40)), (None, say(40)), (1000, None), (1001, ""), (1002, "--- \n"), (1003, "W0 w0 W0-w7"), (1004, say(20000)), (7, say(30)), (7, say(30))]
    copy = say(60)
    return out + [(2000 - i, copy) for i in range(120)]


@pytest.fixture(scope="module")
def items():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(320)] + ["É", "日本", "zero0"]
    out = [(i, " ".join(rng.choices(words, k=rng.choice((1, 3, 12, 60))))) for i in range(40)]
    return out + [(40, "w0 w0 W0 w1"), (41, ""), (42, None), (43, "absent"), (None, "w3 w5"), (5, "w290 w1")]


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("small", [False, True])
def test_every_document_scored(spark, docs, items, small, monkeypatch):
    if small:  # many query blocks, and short lists, long lists and stops in blocks of few documents
        for name, value in (("QUERY_BYTES", 3000), ("BLOCK_DOCS", 100), ("BLOCK_POSTINGS", 3000), ("INTERVAL", 4), ("STOPS", 3), ("SHORT", 5)):
            monkeypatch.setattr(lexical_search, name, value)
    d = spark.createDataFrame([(i, t, 9, "clash") for i, t in docs], "doc_id long, text string, rank int, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, score string")
    for k in (50, 3):
        assert found(lexical_search.search(d, q, k)) == expected(docs, items, k)
    for a, b in ((d.limit(0), q), (d, q.limit(0))):
        assert not found(lexical_search.search(a, b))


def test_bytes_decide_where_hashes_meet(monkeypatch):
    """Words of one hash are told apart."""
    import pyarrow as pa

    from ledgerlake.llm.words import ALNUM, Words, words_of

    def weak(*args, **kwargs):
        w = words_of(*args, **kwargs)
        return Words(w.raw, np.zeros_like(w.hashes), w.starts, w.ends, w.first)

    monkeypatch.setattr(lexical_search, "words_of", weak)
    vocabulary = lexical_search.Vocabulary(["ab", "abc", "ba"])
    place, term = vocabulary.find(weak(pa.array(["ba x ab abd abc", "ab"]), ALNUM))
    assert sorted(zip(place.tolist(), term.tolist())) == [(0, 2), (2, 0), (4, 1), (5, 0)]


def test_norms_beyond_64_bits():
    n = np.array([1, 10**12], np.int64)
    assert lexical_search.norms(n, 10**9, 10**15).tolist() == [50 + 50 * int(x) * 10**9 // 10**15 for x in n]


def test_query_over_whole_table(spark, sf_dir):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()]
    got = found(queries.queries()["op12_ranked_search"](spark, sf_dir))
    assert got == expected(read("documents", "doc_id"), read("benchmark", "item_id"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert got == Counter(con.sql(f"select item_id, rank, doc_id, score from ({lexical_search.ORACLE})").fetchall())
