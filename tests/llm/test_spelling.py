"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerlake.llm import queries, spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def expected(counts, factor=10):
    by_word, neighbours = dict(counts), {w: [] for w in counts}
    gaps = {}
    for w in by_word:  # words without one code point: near words share one, or one is the other's
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            gaps.setdefault(v, []).append(w)
    for some in gaps.values():
        for i, a in enumerate(some):
            for b in some[i + 1 :]:
                if near(a, b):
                    neighbours[a].append(b)
                    neighbours[b].append(a)
    form = {}
    for w, n in by_word.items():
        best = min(set(neighbours[w]), key=lambda v: (-by_word[v], v), default=None)
        form[w] = best if best is not None and by_word[best] >= factor * n else None
    out = set()
    for w, n in by_word.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(set(neighbours[w])), by_word[form[w]] if form[w] else None))
    return out


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(8)
    words = Counter()
    for _ in range(250):
        w = "".join(rng.choice("etaonéü") for _ in range(rng.randint(6, 10)))
        words[w] += rng.choice((1, 30, 400))
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice("etaoxÿ")
            words[rng.choice((w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]))] += rng.choice((1, 3, 40))
    words |= {"chainaaa": 2, "chainaab": 20, "chainabb": 200, "chainbbb": 2000, "alonewordhere": 5, "日本語の文字列です": 3, "日本語の文字列だす": 40, "x" * 3000: 2, "x" * 3001: 30, "a": 4, "": 1}
    return words


def test_all_pairs(spark, counts):
    rows = [*counts.items(), (None, 3)]
    got = result(spelling.variants(spark.createDataFrame(rows, "word string, n long").repartition(3)))
    assert got == expected(counts)
    assert ("chainaaa", "chainaab", "chainbbb", 2, 1, 20) in got
    twice = [(w, k) for w, n in counts.items() for k in (1, n - 1)]
    assert result(spelling.variants(spark.createDataFrame(twice, "word string, n long"))) == got


def test_hot_signatures_are_refined(spark, monkeypatch):
    """Hundreds of words in one signature, in both routes."""
    rng = random.Random(3)
    hot = Counter({"stationary" + "".join(rng.choice("aein") for _ in range(rng.choice((9, 10)))): rng.choice((2, 50, 900)) for _ in range(900)})
    words = spark.createDataFrame(list(hot.items()), "word string, n long")
    want = expected(hot)
    monkeypatch.setattr(spelling, "SAMPLE", 1)
    for least in (2, 1 << 30):  # every shared signature is hot; none is
        monkeypatch.setattr(spelling, "SAMPLE_HOT", least)
        assert result(spelling.variants(words)) == want
    monkeypatch.setattr(spelling, "HOT_BYTES", -1)  # a join in place of the broadcast
    monkeypatch.setattr(spelling, "SAMPLE_HOT", 2)
    assert result(spelling.variants(words)) == want


def corpus(docs):
    n = Counter()
    for d, t in docs:
        for run in LETTERS.findall(t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    return Counter({w: c for w, c in n.items() if c >= 2})


def test_corpus_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeÉß") for _ in range(rng.randint(5, 12))) for _ in range(60)] + ["ÀÉÿ×÷abcd", "Straßenbahn"]
    docs = [(i, "1".join(rng.choice(words) + rng.choice(("", " ", "'s ")) for _ in range(40))) for i in range(60)]
    docs += [(7, None), (8, ""), (None, "Straßenbahn STRASSENBAHN strassenbahn"), (9, "longword " * 20000), (9, "longword"), (10, "y" * 100000 + " " + "y" * 100000)]
    frame = spark.createDataFrame([(d, t, "clash", "clash") for d, t in docs], "doc_id long, text string, word string, n string").repartition(3)
    got = spelling.corpus_words(frame)
    assert {r["word"]: r["n"] for r in got.collect()} == dict(corpus(docs))
    assert result(spelling.variants(got)) == expected(corpus(docs))
    assert result(spelling.variants(spelling.corpus_words(frame.limit(0)))) == set()


def test_query_over_whole_table(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.queries()["op13_spelling_variants"](spark, sf_dir)) == expected(corpus(docs))
