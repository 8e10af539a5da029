"""Benchmark decontamination by winnowing (operator 7).

Words are ASCII letters and digits, lower-cased, and all other characters above
ASCII.  A window is ``window`` (10) consecutive words of a benchmark item; an
item of fewer words is one window.  Every document word inside an occurrence of
a window is hit.

Method: of each run of 10 words the smallest of its six 5-gram hashes (the
rightmost of equals) is kept, on both sides by the same rule.  Two equal runs
of 10 words keep the same 5-gram, so every shared span of 10 words or more
meets in a fingerprint.  Items below 10 words are fingerprints themselves, one
gram length for each such length.  Fingerprints of documents and items are
joined; each meeting is extended: the windows around it (128-bit hashes) are
joined with the items' windows.

Scale: both joins are shuffles, whatever the benchmark's size.  What is
broadcast is a Bloom filter of the items' fingerprints, at most
``FILTER_BITS`` (16 MB): it keeps most fingerprints of clean documents out of
the shuffle, a larger benchmark lets more of them through, and the joins decide
either way.  Documents enter by a digest of their text, so copies meet the
benchmark once a task; the item side of the first join has one row per
fingerprint and that of the second one per window, so a gram that all items
and all documents hold costs its documents' rows, not their product, and
Spark splits such a key's rows over tasks.  Only a document's own hit items
(its result) are listed per document.  Hits return to the documents by digest;
they are broadcast where their counted size is below ``HITS_BYTES``, else
joined by a shuffle.

Defined results: null texts have no words; items without words or with a null
id are no items; repeated items count once; null document ids are carried;
empty tables give no hits or no rows; other columns are carried, and those
named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import carried, restored, settle
from .words import ALNUM, U, Words, mix, signed, slices, word_counts, words_of
from .workers import lean

GRAM = 5
FILTER_BITS = 1 << 27
HITS_BYTES = 16 << 20


def winnow(w: Words, window: int) -> np.ndarray:
    """Positions of the grams kept by winnowing: the rightmost smallest of each window's."""
    h, m = w.grams(GRAM), len(w.hashes)
    at = np.arange(m)
    best, where = h.copy(), at.copy()
    for k in range(1, window - GRAM + 1):
        later = h[k:] <= best[: m - k]
        best[: m - k][later] = h[k:][later]
        where[: m - k][later] = at[k:][later]
    return np.unique(where[w.whole(window)])


def fingerprints(w: Words, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the fingerprints for windows of n words: winnowed grams of the full
    window, every gram of a shorter one.  Keys of different n do not meet."""
    if n == window:
        at = winnow(w, window)
        return at, w.grams(GRAM)[at]
    at = np.flatnonzero(w.whole(n))
    return at, mix(w.grams(n)[at] + U(n))


def _items(window: int):
    """Rows of an item's fingerprints, then of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                w = words_of(batch.column(1), ALNUM, fold=True)
                owner, size = w.owner(), np.minimum(w.counts, window)
                for n in range(1, window + 1):
                    its = size[owner] == n
                    at, key = fingerprints(w, n, window)
                    key = key[its[at]]
                    start = np.flatnonzero(its & w.whole(n))
                    blank = pa.nulls(len(key), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), n)), pa.array(signed(key)), blank, blank, pa.nulls(len(key), pa.string())], ["n", "f", "u", "v", "item"])
                    u, v = (w.grams(n, b)[start] for b in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), n)), pa.nulls(len(start), pa.int64()), pa.array(signed(u)), pa.array(signed(v)), batch.column(0).take(pa.array(owner[start]))], ["n", "f", "u", "v", "item"])

    return run


def _candidates(window: int, lengths: list[int], bloom):
    """Per fingerprint that passes the filter, the windows that it may lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for whole in batches:
            for batch in slices(whole, 1):
                w = words_of(batch.column(1), ALNUM, fold=True)
                owner = w.owner()
                for n in lengths:
                    at, key = fingerprints(w, n, window)
                    known = np.ones(len(key), bool)
                    for half in (key, key >> U(32)):
                        slot = half & U(len(bits) * 64 - 1)
                        known &= (bits[slot >> U(6)] >> (slot & U(63)) & U(1)).astype(bool)
                    at, key = at[known], key[known]
                    if not len(at):
                        continue
                    inside = w.whole(n)
                    spread = np.arange(window - GRAM + 1 if n == window else 1)
                    start = at[:, None] - spread
                    good = start >= w.first[owner[at]][:, None]
                    good &= inside[np.maximum(start, 0)]
                    ends = np.concatenate([[0], np.cumsum(good.sum(1))]).astype(np.int32)
                    flat = start[good]
                    place = flat - w.first[owner[flat]]
                    windows = pa.StructArray.from_arrays([pa.array(place.astype(np.int64)), *(pa.array(signed(w.grams(n, b)[flat])) for b in (0, 1))], ["start", "u", "v"])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at])), pa.array(np.full(len(at), n)), pa.array(signed(key)), pa.ListArray.from_arrays(pa.array(ends), windows)], ["k", "n", "f", "windows"])

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges that a document's windows cover together."""
    for batch in batches:
        spans, n_hit = [], []
        for hits in batch.column(1):
            found = np.array([(s, h["n"]) for h in hits.as_py() for s in h["starts"]], np.int64).reshape(-1, 2)
            found = found[np.argsort(found[:, 0], kind="stable")]
            stop = np.maximum.accumulate(found.sum(1))
            new = np.append(True, found[1:, 0] > stop[:-1])
            start, stop = found[new, 0], stop[np.append(np.flatnonzero(new)[1:], len(found)) - 1]
            spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(start, stop)])
            n_hit.append(int((stop - start).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(n_hit, pa.int64())], ["k", "spans", "n_hit"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 0):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_counts(batch.column(0), ALNUM))], ["text", "k", "rest", "n_words"])


def bloom_filter(keys: DataFrame, many: int) -> np.ndarray:
    """A bit table of the keys ``f``, two bits each: 16 bits a key, FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * many).bit_length()))
    slots = keys.select(F.explode(F.array(F.col("f"), F.shiftrightunsigned("f", 32))).alias("s")).select(F.col("s").bitwiseAND(F.lit(bits - 1)).alias("s"))
    # Rows of 64 bits: bits / 64 at most, whatever the benchmark.
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, U)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(U)
    return table


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (ids as strings, sorted), hit_spans (word ranges,
    stop exclusive) and contaminated (n_hit > 0)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null")
    items = settle(items.mapInArrow(lean(_items(window)), "n long, f long, u long, v long, item string").distinct())
    keys = items.where("f is not null").select("n", "f").distinct()
    windows = items.where("f is null").select("n", "u", "v", "item")
    many = {r["n"]: r["c"] for r in keys.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row per window length
    bloom = spark.sparkContext.broadcast(bloom_filter(keys, sum(many.values())))
    text = F.col(f"`{text_col}`")
    digest = F.unhex(F.md5(text))
    found = docs.where(text.isNotNull()).select(digest.alias("k"), text.alias("t"))
    found = found.mapInArrow(lean(_candidates(window, sorted(many), bloom)), "k binary, n long, f long, windows array<struct<start:long,u:long,v:long>>")
    met = found.join(keys, ["n", "f"], "left_semi").select("k", "n", F.explode("windows").alias("w")).select("k", "n", "w.*")
    met = met.groupBy("k", "n", "u", "v").agg(F.collect_set("start").alias("starts"))
    hits = settle(met.join(windows.select("n", "u", "v").distinct(), ["n", "u", "v"], "left_semi"))
    spans = hits.groupBy("k").agg(F.collect_list(F.struct("n", "starts")).alias("hits")).mapInArrow(lean(_spans), "k binary, spans array<struct<start:long,stop:long>>, n_hit long")
    names = hits.select("k", "n", "u", "v").join(windows, ["n", "u", "v"]).groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = settle(spans.join(names, "k"))
    size = hits.agg(F.coalesce(F.sum(32 + 16 * F.size("spans") + F.octet_length(F.array_join("items", ","))), F.lit(0)).alias("n")).head()["n"]
    rows = docs.select(text.alias("text"), digest.alias("k"), carried(docs, text_col).alias("rest"))
    rows = rows.mapInArrow(lean(_counted), f"text string, k binary, rest {rows.schema['rest'].dataType.simpleString()}, n_words long")
    state = rows.join(F.broadcast(hits) if size <= HITS_BYTES else hits, "k", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    made = {text_col: F.col("text"), "n_words": F.col("n_words"), "n_hit": n_hit, "hit_items": F.coalesce("items", F.array().cast("array<string>")), "hit_spans": F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")), "contaminated": n_hit > 0}
    return restored(state, docs.columns, made)
