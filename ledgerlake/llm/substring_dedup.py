"""Removal of word passages that repeat across documents (operator 4).

A window is ``window`` consecutive words of one document.  A word goes if some
window that covers it begins, word for word, also in a document with a smaller
id; windows are judged on the input, not on what is left of it.

Method: difference-cover anchors.  Positions whose index modulo 31 lies in the
perfect difference set ``COVER`` are anchors; for any two alignments there is a
shift below 31 at which both positions are anchors.  So if two documents share
a window of 50 words, they share the hash of a 20-word anchor inside it, and
only 6 of 31 positions are shuffled to find that out.  Around the anchors that
occur in two or more documents the full windows are hashed (128 bits), sorted,
and every occurrence after the smallest id is marked (the extension step).  No
pairs are made: a run of equal hashes is streamed, keeping its first id only.

Scale and skew:

* the texts are shuffled once, by id and a 33-bit hash of the text, so an id that
  many rows share is spread as far as its texts differ; every later pass and
  join is by the same two and reuses that exchange (hence no filter or
  projection of its own);
* documents equal to one with a smaller id are settled by a digest beforehand;
* a batch settles what it sees twice itself (for windows: all but the smallest
  id of a hash are already decided) and sends the decided rows on under a key
  made of the document, so a hash that a third of all documents hold reaches
  its task once or twice a batch, not once an occurrence;
* results per document are positions, bounded by the document's own length.

Defined results: a null text has no words; a null id neither removes nor loses
words; repeated rows of one id never remove each other's words; a repeat within
one document stays; an empty table gives an empty table; other columns are
carried, and those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import carried, restored, shuffle_width
from .words import SPACED, mix, signed, slices, words_of
from .workers import lean

PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
"""A perfect difference set: every difference modulo 31 occurs once."""
PLACE = (1 << 30) - 1
"""Positions carry a tag of their text above these bits, for ids that have several texts; a text
has fewer words than that, as Spark's strings have at most 2 GB."""


def anchor_words(window: int) -> int:
    """The longest anchor that every shared window must hold in full."""
    if window < PERIOD:
        raise ValueError(f"the window must have {PERIOD} words or more")
    return window - PERIOD + 1


def _first_of_run(keys: list[np.ndarray]) -> np.ndarray:
    """Which rows of sorted columns begin a run of equal rows."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _anchors(window: int):
    length, cover = anchor_words(window), np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            judged = pc.and_(pc.invert(whole.column(4)), pc.and_(whole.column(0).is_valid(), whole.column(1).is_valid()))
            for batch in slices(whole.select([0, 1, 2]).filter(judged), 1):
                ids, w = batch.column(0).to_numpy(zero_copy_only=False), words_of(batch.column(1))
                tag = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), w.counts)
                place = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], w.counts)
                at = np.flatnonzero(w.whole(length) & cover[place % PERIOD] & np.repeat(w.counts >= window, w.counts))
                h, d, p = w.grams(length)[at], ids[w.owner()[at]], place[at] + tag[at]
                order = np.lexsort((p, d, h))
                h, d, p = h[order], d[order], p[order]
                run_of = np.cumsum(_first_of_run([h])) - 1
                if len(h):
                    low, high = d[_first_of_run([h])], d[np.append(_first_of_run([h])[1:], True)]
                    twice = (low != high)[run_of]
                    # The batch's smallest id of a shared anchor tells other batches; the rest need no company.
                    lead = ~twice | _first_of_run([h])
                    tell = pa.RecordBatch.from_arrays([pa.array(signed(h[lead])), pa.array(d[lead]), pa.array(p[lead]), pa.array(np.zeros(lead.sum(), bool))], ["h", "d", "p", "sure"])
                    yield tell
                    k = np.flatnonzero(twice)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(mix(d[k].astype(np.uint64) + p[k].astype(np.uint64)))), pa.array(d[k]), pa.array(p[k]), pa.array(np.ones(len(k), bool))], ["h", "d", "p", "sure"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and id: positions whose hash two ids or more have."""
    held = None  # the open run: its hash, first id, positions while it has one id only, whether it has more
    for batch in batches:
        h, d, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        sure = batch.column(3).to_numpy(zero_copy_only=False)
        out = [(d[sure], p[sure])]
        h, d, p = h[~sure], d[~sure], p[~sure]
        if len(h):
            edges = np.flatnonzero(_first_of_run([h]))
            run_of = np.cumsum(_first_of_run([h])) - 1
            stops = np.append(edges[1:], len(h))
            many = d[edges] != d[stops - 1]
            if held is not None and held[0] == h[0]:
                if many[0] or held[3] or held[1] != d[0]:
                    many[0] = True
                    out.append((np.full(len(held[2]), held[1]), held[2]))
                    held = (h[0], held[1], held[2][:0], True)
            k = many[run_of]
            last = edges[-1]
            out.append((d[k], p[k]))
            old = held[2] if held is not None and held[0] == h[-1] else np.zeros(0, np.int64)
            held = (h[-1], d[last], p[:0], True) if many[-1] else (h[-1], d[last], np.append(old, p[last:]), False)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out]).astype(np.int64)), pa.array(np.concatenate([x for _, x in out]).astype(np.int64))], ["d", "p"])


def _windows(window: int):
    """Windows at up to 30 places before the shared anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            judged = pc.and_(pc.invert(whole.column(4)), whole.column(5).is_valid())
            for batch in slices(whole.select([0, 1, 2, 5]).filter(judged), 1):
                ids, w = batch.column(0).to_numpy(zero_copy_only=False), words_of(batch.column(1))
                marks = np.zeros(len(w.hashes) + 1, np.int32)
                anchors, tags = batch.column(3), batch.column(2).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(anchors)), pc.list_value_length(anchors).to_numpy(zero_copy_only=False))
                at = anchors.flatten().to_numpy(zero_copy_only=False)
                own = at & ~PLACE == tags[owner]
                at = (at & PLACE)[own] + w.first[owner[own]]
                np.add.at(marks, np.maximum(at - PERIOD + 1, np.repeat(w.first[:-1], w.counts)[at] if len(at) else at), 1)
                np.add.at(marks, at + 1, -1)
                k = np.flatnonzero((np.cumsum(marks)[:-1] > 0) & w.whole(window))
                place = k - np.repeat(w.first[:-1], w.counts)[k] + tags[w.owner()[k]]
                h, g, d = w.grams(window)[k], w.grams(window, 1)[k], ids[w.owner()[k]]
                order = np.lexsort((d, g, h))
                h, g, d, place = h[order], g[order], d[order], place[order]
                first = _first_of_run([h, g])
                lost = d != d[first][np.cumsum(first) - 1] if len(d) else np.zeros(0, bool)
                away = mix(d.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.where(lost, away, h))), pa.array(signed(np.where(lost, away, g))), pa.array(d.astype(np.int64)), pa.array(place), pa.array(lost)], ["h", "g", "d", "p", "lost"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and id: those after the smallest id of their hash."""
    held = None
    for batch in batches:
        h, g, d, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        lost = batch.column(4).to_numpy(zero_copy_only=False).copy()
        k = np.flatnonzero(~lost)
        if len(k):
            first = _first_of_run([h[k], g[k]])
            lead = d[k][first]
            if held is not None and held[:2] == (h[k[0]], g[k[0]]):
                lead[0] = held[2]
            lost[k] = d[k] != lead[np.cumsum(first) - 1]
            held = (h[k[-1]], g[k[-1]], lead[-1])
        yield pa.RecordBatch.from_arrays([pa.array(d[lost]), pa.array(p[lost])], ["d", "p"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                w, texts = words_of(batch.column(1)), batch.column(1).to_pylist()
                copy, tags = batch.column(4).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                kept, removed, spans = [], [], []
                for i, found in enumerate(batch.column(5)):
                    lo, hi = w.first[i], w.first[i + 1]
                    gone = np.zeros(hi - lo + 1, np.int32)
                    if copy[i] and hi - lo >= window:
                        gone[:-1] = 1
                    elif found.is_valid and len(found):
                        at = np.unique(found.values.to_numpy(zero_copy_only=False))
                        at = at[at & ~PLACE == tags[i]] & PLACE
                        gone[at] += 1
                        np.add.at(gone, np.minimum(at + window, hi - lo), -1)
                        gone = (np.cumsum(gone) > 0).astype(np.int32)
                        gone[-1] = 0
                    edge = np.flatnonzero(np.diff(gone, prepend=0))
                    spans.append([{"start": int(s), "stop": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                    words = (texts[i] or "").encode().split()
                    kept.append(b" ".join(x for x, g in zip(words, gone) if not g).decode() if len(edge) else b" ".join(words).decode())
                    removed.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(kept, pa.string()), pa.array(w.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["d", "text", "rest", "kept_text", "n_words", "n_removed", "removed_spans"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with kept_text (kept words joined by one space), n_words, n_removed and
    removed_spans (word ranges, stop exclusive); see the module for all defined cases."""
    anchor_words(window)
    n = shuffle_width(docs.sparkSession)
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    tag = F.coalesce(F.xxhash64(text), F.lit(0)).bitwiseAND(F.lit((1 << 33) - 1)) * F.lit(PLACE + 1)
    base = docs.select(key.alias("d"), text.alias("text"), tag.alias("t"), carried(docs, id_col, text_col).alias("rest")).repartition(n, "d", "t")
    digests = docs.select(key.alias("d"), tag.alias("t"), F.sha2(text, 256).alias("k")).where("d is not null and k is not null").distinct()
    leads = digests.groupBy("k").agg(F.min("d").alias("first"))
    # A copy is told by id and digest, should two texts of an id have one tag.
    copied = digests.join(leads, "k").where("d > first").groupBy("d", "t").agg(F.collect_set("k").alias("ks"))
    # Every reader below takes all rows and columns of ``base``, filtering inside: so all share its one exchange.
    marked = base.join(copied.hint("shuffle_hash"), ["d", "t"], "left").withColumn("copy", F.coalesce(F.array_contains("ks", F.sha2("text", 256)), F.lit(False))).select("d", "text", "t", "rest", "copy")
    anchors = marked.mapInArrow(lean(_anchors(window)), "h long, d long, p long, sure boolean")
    shared = anchors.repartition(n, "h").sortWithinPartitions("h", "d").mapInArrow(lean(_shared), "d long, p long")
    own = F.col("p").bitwiseAND(F.lit(~PLACE)).alias("t")
    near = shared.groupBy("d", own).agg(F.collect_set("p").alias("at"))
    windows = marked.join(near.hint("shuffle_hash"), ["d", "t"], "left").select("d", "text", "t", "rest", "copy", "at").mapInArrow(lean(_windows(window)), "h long, g long, d long, p long, lost boolean")
    later = windows.repartition(n, "h", "g").sortWithinPartitions("h", "g", "d").mapInArrow(lean(_later), "d long, p long")
    gone = later.groupBy("d", own).agg(F.collect_set("p").alias("gone"))
    ready = marked.join(gone.hint("shuffle_hash"), ["d", "t"], "left").select("d", "text", "t", "rest", "copy", "gone")
    rest = ready.schema["rest"].dataType.simpleString()
    cut = ready.mapInArrow(lean(_cut(window)), f"d long, text string, rest {rest}, kept_text string, n_words long, n_removed long, removed_spans array<struct<start:long,stop:long>>")
    made = {id_col: F.col("d"), text_col: F.col("text")} | {c: F.col(c) for c in ("kept_text", "n_words", "n_removed", "removed_spans")}
    return restored(cut, docs.columns, made)
