"""Packing of tokenised documents into windows (operator 3), by minimum bin slack.

1. Every document is tokenised once (``tokens``); a separator id ends it.  Each
   full window's worth of ids is a piece of its own that fills a sequence; the
   remaining tail (shorter than the window) is packed.
2. The tails' lengths are counted: a histogram of at most ``window`` - 1 entries,
   the only thing that reaches the driver, whatever the corpus.
3. ``plan`` fills windows from that histogram.  A bitset subset-sum dynamic
   program (a Python integer is the bitset) finds the multiset of remaining
   lengths, with the largest one in it, whose sum is closest to the window;
   backtracking gives its counts, and the pattern is repeated as often as the
   counts allow.  Where no subset is exact, the slack is filled by cutting the
   largest length outside the pattern.  The last window's rest is split into
   powers of two, which need no padding.  Each step uses up a length or cuts
   the number of items by a factor, so the plan stays small.
4. Tails of one length are interchangeable: each gets a rank among them
   (per length and bucket of rows by their place in the input, so neither a
   length nor a row that a third of all rows share is ranked in one task) and
   looks its place up in the plan.

The broadcast plan is bounded by the window, not by the data: at most ``window``
patterns of distinct lengths that sum to the window.

Defined results: a null text is empty (its only id is the separator); repeated
rows are packed each; null ids are carried; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import settle, shuffle_width
from .tokens import encoder
from .words import slices
from .workers import lean

SLICE_BYTES = 4 << 20


def closest_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset with the largest length in it whose sum is closest to the window from below."""
    top = max(counts)
    reach, steps = 1 << top, []
    mask = (1 << (window + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == top), (window - top) // length)
        k = 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach = (reach | reach << (k * length)) & mask
            left -= k
            k *= 2
        if reach >> window & 1:
            break
    total = reach.bit_length() - 1
    used = {top: 1}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= k * length
    return used


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, ...]], int]:
    """Rows (length, rank from, rank to, cut start, cut length, first sequence, offset,
    copies in a sequence), and the number of sequences."""
    pool = {n: deque([(n, 0, c, 0)]) for n, c in histogram.items() if c}
    counts = {n: c for n, c in histogram.items() if c}
    rows: list[tuple[int, ...]] = []
    sequence = 0

    def take(length: int, n: int) -> list[tuple[int, int, int, int]]:
        """n items of a length, in segments of equal origin."""
        out, left = [], n
        while left:
            origin, lo, hi, start = pool[length].popleft()
            k = min(left, hi - lo)
            out.append((origin, lo, lo + k, start))
            if lo + k < hi:
                pool[length].appendleft((origin, lo + k, hi, start))
            left -= k
        counts[length] -= n
        if not counts[length]:
            del counts[length], pool[length]
        return out

    def place(length: int, per: int, windows: int, offset: int) -> None:
        """``per`` items of a length go to each of the next windows."""
        done = 0
        for origin, lo, hi, start in take(length, per * windows):
            while lo < hi:
                # Segments may begin or end inside a window.
                inside = done % per
                k = min(hi - lo, per - inside) if inside or hi - lo < per else (hi - lo) // per * per
                rows.append((origin, lo, lo + k, start, length, sequence + done // per, offset + inside * length, per if not inside and k >= per else k))
                lo, done = lo + k, done + k

    while counts:
        used = closest_fill(counts, window)
        total = sum(n * c for n, c in used.items())
        slack = window - total
        outside = [n for n, c in counts.items() if c > used.get(n, 0)]
        if slack and not outside:
            break
        donor = max(outside) if slack else None
        windows = min(counts[n] // (c + (n == donor)) for n, c in used.items())
        if slack:
            windows = min(windows, counts[donor] // (1 + used.get(donor, 0)))
        offset = 0
        for n in sorted(used, reverse=True):
            place(n, used[n], windows, offset)
            offset += n * used[n]
        if slack:
            for k, (origin, lo, hi, start) in _numbered(take(donor, windows)):
                rows.append((origin, lo, hi, start, slack, sequence + k, offset, 1))
                pool.setdefault(donor - slack, deque()).append((origin, lo, hi, start + slack))
            counts[donor - slack] = counts.get(donor - slack, 0) + windows
        sequence += windows
    # The rest fits one window: powers of two if that saves padding worth it.
    rest = sum(n * c for n, c in counts.items())
    sizes = [window] if window - rest <= window // 64 else [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]
    left, offset = (sizes.pop(0) if sizes else 0), 0
    for length in sorted(counts, reverse=True):
        for origin, lo, hi, start in take(length, counts[length]):
            for rank in range(lo, hi):
                at = 0
                while at < length:
                    if not left:
                        left, offset, sequence = sizes.pop(0), 0, sequence + 1
                    k = min(left, length - at)
                    rows.append((origin, rank, rank + 1, start + at, k, sequence, offset, 1))
                    at, left, offset = at + k, left - k, offset + k
    return rows, sequence + (rest > 0)


def _numbered(segments):
    k = 0
    for s in segments:
        yield k, s
        k += s[2] - s[1]


def _lookup(rows: list[tuple[int, ...]]) -> tuple[np.ndarray, ...]:
    """The plan by elementary rank intervals: sorted keys, row lists, and the rows."""
    by: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(r[0], []).append(i)
    keys, offsets, members = [], [0], []
    for length in sorted(by):
        cuts = sorted({x for i in by[length] for x in rows[i][1:3]})
        inside: dict[int, list[int]] = {c: [] for c in cuts}
        position = {c: k for k, c in enumerate(cuts)}
        for i in by[length]:
            for k in range(position[rows[i][1]], position[rows[i][2]]):
                inside[cuts[k]].append(i)
        for c in cuts:
            keys.append(length << 44 | c)
            members += inside[c]
            offsets.append(len(members))
    return np.array(keys, np.int64), np.array(offsets, np.int64), np.array(members, np.int64), np.array(rows, np.int64).reshape(-1, 8)


def _tokenise(path: str, window: int, separator: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        small = max(len(tokens.token_bytes), separator + 1) <= 1 << 16
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                ids, lengths = tokens.encode(batch.column(1))
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, separator).astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                starts = ends - lengths - 1
                crcs, kept = [], []
                for a, b in zip(starts, ends):
                    full = (b - a) // window
                    crcs.append([zlib.crc32(ids[a + k * window : a + (k + 1) * window]) for k in range(full)])
                    some = ids[a if with_ids else a + full * window : b]
                    kept.append(some.astype("<u2").tobytes() if small else some.tobytes())
                tails = np.array([zlib.crc32(ids[a + (b - a) // window * window : b]) for a, b in zip(starts, ends)], np.int64)
                n = lengths + 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n % window), pa.array(tails), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(np.full(len(n), 2 if small else 4))], ["d", "n", "tail", "crc", "full", "ids", "width"])

    return run


def _place(lookup, sequences: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, offsets, members, rows = lookup.value
        fresh = sequences + (TaskContext.get().partitionId() << 40)
        for batch in batches:
            n, tail, crc, rank, width = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 6, 7))
            full, kept = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            out: list[tuple] = []
            found = np.searchsorted(keys, (tail << 44) | np.where(tail > 0, rank, 0), side="right") - 1
            for i in range(batch.num_rows):
                base = len(full[i]) * window
                ids = lambda a, b: np.frombuffer(kept[i], f"<u{width[i]}")[a:b].astype("<u4")  # noqa: B023, E731
                begin = 0 if with_ids else base
                for k, c in enumerate(full[i]):
                    out.append((i, k * window, window, c, fresh, 0))
                    fresh += 1
                if not tail[i]:
                    continue
                for m in members[offsets[found[i]] : offsets[found[i] + 1]]:
                    _, lo, _, start, length, sequence, offset, per = rows[m]
                    j = rank[i] - lo
                    value = crc[i] if length == tail[i] else zlib.crc32(ids(base + start - begin, base + start + length - begin))
                    out.append((i, base + start, length, value, sequence + j // per, offset + j % per * length))
            index = pa.array([o[0] for o in out], pa.int64())
            columns = [pa.array([int(o[k]) for o in out], pa.int64()) for k in range(1, 6)]
            pieces = [kept[i][a * width[i] : (a + m) * width[i]] if with_ids else None for i, a, m, *_ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), columns[0], columns[1], columns[2], pa.array(n).take(index), columns[3], columns[4], pa.array(pieces, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, separator: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    on request, the ids themselves (little-endian, as narrow as the vocabulary allows)."""
    base = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("text"))
    kind = base.schema["d"].dataType.simpleString()
    tokens = base.mapInArrow(lean(_tokenise(tokenizer_path, window, separator, with_ids), tokens=True), f"d {kind}, n long, tail long, crc long, full array<long>, ids binary, width long")
    # The bucket is set by the place in the input, and kept: ranks and offsets read the same rows.
    bucket = settle(tokens.withColumn("sub", F.pmod(F.monotonically_increasing_id(), F.lit(shuffle_width(docs.sparkSession)))))
    per = bucket.where("tail > 0").groupBy("tail", "sub").agg(F.count(F.lit(1)).alias("c"))
    rows, sequences = plan({r["tail"]: r["n"] for r in per.groupBy("tail").agg(F.sum("c").alias("n")).collect()}, window)
    lookup = docs.sparkSession.sparkContext.broadcast(_lookup(rows))
    before = per.withColumn("before", F.sum("c").over(Window.partitionBy("tail").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))).drop("c")
    ranked = bucket.withColumn("rank", F.row_number().over(Window.partitionBy("tail", "sub").orderBy("d", "crc", "n")) - 1)
    ranked = ranked.join(before, ["tail", "sub"], "left").withColumn("rank", (F.col("rank") + F.coalesce("before", F.lit(0))).cast("long"))
    placed = ranked.select("d", "n", "tail", "crc", "full", "ids", "rank", "width")
    return placed.mapInArrow(lean(_place(lookup, sequences, window, with_ids)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
