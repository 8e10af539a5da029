"""Segment-tree BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, queries

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
AWKWARD = [None, "", " \t\n", "a", "A", "it's IT'S we'LL 'S ''s !'s", "x" * 3000, "ab" * 40000, "1234567 ٣٤ Ⅷ ½", "<|startoftext|>Hi<|endoftext|><|endoftext|>!", "<|startoftext |> <|ENDOFTEXT|>", "İstanbul ΑΣ ﬁ Å é ́x ǅ ẞ",
           "日本語のテキスト。" * 30, "\x00\x1c\x1d\x85\xa0 　﻿​|", "👩‍👩‍👧 🏳️‍🌈", "tab\x0bvt\x0cff\r\nx", "…—“quoted”…", "\U0010ffff  ͸"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    letters = "aabcdeeilnorstu'.,-  é́ßñ12\nŽЖ中<|>"
    return AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(400)]


@pytest.mark.parametrize("name", NAMES)
def test_like_the_library(name, texts, monkeypatch):
    lib, code = library(name), bpe.Coder(public_tokenizers.path(name))
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for small in (False, True):  # caches that fill up change nothing
        if small:
            monkeypatch.setattr(bpe, "CACHE_CHUNKS", 20)
            monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
            monkeypatch.setattr(bpe, "FOREST", 4)
        ids, lengths = code.encode(pa.array(texts, pa.string()))
        flat = iter(ids.tolist())
        assert [[next(flat) for _ in range(n)] for n in lengths] == want
    for w in want:
        assert code.decode(w) == lib.decode(w, skip_special_tokens=False)


def test_every_character(texts):
    """Each code point alone, after a letter and before one."""
    lib, code = library(NAMES[0]), bpe.Coder(public_tokenizers.path(NAMES[0]))
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3100, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    rows = [f"{c}a{c} b{c}{c} {c}" for c in points]
    ids, lengths = code.encode(pa.array(rows))
    want = [e.ids for e in lib.encode_batch(rows, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_merge_is_leftmost_lowest():
    """Against a scan of all pairs for each merge, on random merge tables."""
    rng = random.Random(2)
    for _ in range(400):
        ranks, merged, size = {}, [], 4
        for r in range(rng.randint(0, 12)):
            pair = rng.randrange(size) * bpe._STEP + rng.randrange(size)
            if pair not in ranks:
                ranks[pair] = len(merged)
                merged.append(size)
                size += 1
        word = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        slow = list(word)
        while pairs := [(ranks[a * bpe._STEP + b], i) for i, (a, b) in enumerate(zip(slow, slow[1:])) if a * bpe._STEP + b in ranks]:
            r, i = min(pairs)
            slow[i : i + 2] = [merged[r]]
        assert bpe.merge(list(word), ranks, merged) == slow
        if word:
            row = np.full((2, rng.randint(max(2, len(word)), 50)), -1, np.int64)
            row[:, : len(word)] = word
            done = bpe.merge_forest(row, np.array([len(word)] * 2), bpe.Ranks(ranks, merged))
            assert [r[r >= 0].tolist() for r in done] == [slow] * 2


def test_operator(spark, texts):
    lib = library(NAMES[0])
    rows = [(i % 50, t, "clash", 1.5) for i, t in enumerate(texts)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, other double").repartition(3)
    got = bpe.encode_decode(frame, public_tokenizers.path(NAMES[0]))
    assert got.columns == ["doc_id", "text", "ids", "other", "n_tokens", "decoded"]
    seen = 0
    for r in got.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == lib.decode(ids, skip_special_tokens=False) and r["other"] == 1.5
        seen += 1
    assert seen == len(rows)
    assert bpe.encode_decode(frame.limit(0), public_tokenizers.path(NAMES[0])).count() == 0


def test_query_over_whole_table(spark, sf_dir):
    lib = library(NAMES[0])
    want = set()
    for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((d, len(ids), digest(" ".join(map(str, ids))), digest(lib.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in queries.queries()["op11_bpe"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(want) and set(got) == want
