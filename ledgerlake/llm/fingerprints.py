"""Document fingerprints by a quartile bucket digest (operator 8).

Every four consecutive bytes give three byte triplets; each is hashed into one
of 256 buckets.  The digest writes, for every bucket, which quartile its count
lies in (two bits), after a byte for the logarithm of the length and a byte for
the quartiles' ratio.  Two digests differ by the distance of their bucket codes
(a jump over all quartiles counts double) and by their length codes, up to
``WORST``; likeness is 1 minus that share.  Equal texts have equal digests.

``with_neighbours`` also compares each text with the next document in
descending id order and with an edited text made of both.  Order at scale: ids
are cut into ranges by quantiles; an id (or no id) that several quantiles fall
on has a range of its own, which is cut further by the texts' hashes, so an id
that a third of all rows have is spread like any others.  Each range's first
document is sent to the range before it as well, so every row meets its
successor inside one sorted partition and the texts are shuffled once.

Defined results: a null text is empty; equal ids are ordered by a hash of their
text, descending; null ids come last; a single document is its own successor;
an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import shuffle_width
from .words import slices
from .workers import lean

BUCKETS = 256
LENGTH_STEP = math.log(1.1)
WORST = BUCKETS * 4 + 64
RANGES_PER_PARTITION = 4


def digest(data: bytes) -> bytes:
    """Two bytes of header and 64 of bucket quartiles."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    if len(raw) >= 4:
        for lo in range(0, len(raw) - 3, 1 << 20):
            a, b, c, d = (raw[lo + k : min(lo + (1 << 20), len(raw) - 3) + k] for k in range(4))
            for salt, (x, y, z) in ((0x9E3779B1, (a, b, c)), (0x85EBCA77, (a, b, d)), (0xC2B2AE3D, (a, c, d))):
                h = (x << np.uint32(16) | y << np.uint32(8) | z) * np.uint32(salt | 1)
                counts += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(24), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    size = min(255, int(math.log1p(len(data)) / LENGTH_STEP))
    ratio = int(15 * q1 / q3) << 4 | int(15 * q2 / q3) if q3 else 0
    return bytes([size, ratio]) + (codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, down to 0."""
    x, y = (np.unpackbits(np.frombuffer(d, np.uint8, offset=2), bitorder="little").reshape(-1, 2) @ np.array([1, 2]) for d in (a, b))
    gap = np.abs(x - y)
    apart = int((gap + (gap == 3)).sum()) + min(64, abs(a[0] - b[0]))
    return 1.0 - min(WORST, apart) / WORST


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order: each own row with the row after it."""
    waiting: tuple | None = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    for batch in (part for whole in batches for part in slices(whole, 2)):
        made = []
        zone, ids, texts, guest = (batch.column(i).to_pylist() for i in range(4))
        for z, d, t, g in zip(zone, ids, texts, guest):
            print_ = digest(t.encode())
            if waiting is not None and waiting[0] == z:
                _, own, text, code = waiting
                half = len(text) // 2
                edited = text[: len(text) - half] + t[:half]
                changed = digest(edited.encode())
                made.append((own, len(text), hashlib.sha256(edited.encode()).hexdigest(), code.hex(), changed.hex(), likeness(code, changed), likeness(code, print_)))
                waiting = None
            if not g:
                waiting = (z, d, t, print_)
        yield out(made)


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n = shuffle_width(docs.sparkSession) * RANGES_PER_PARTITION
    facts = base.agg(F.percentile_approx("d", [k / n for k in range(1, n)] or [0.5], 10 * n).alias("q"), F.count("d").alias("with_id"), F.count(F.lit(1)).alias("all")).head()
    cuts = Counter(int(c) for c in facts["q"] or [])
    # Cuts are rounded to doubles; ids that hold a range or more are counted as they are, n of them at most.
    near = [float(c) for c, k in cuts.items() if k > 1]
    alike = base.where(F.col("d").cast("double").isin(near)).groupBy("d").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * n >= facts["all"]) if near else None
    hot = {r["d"]: max(1, round(r["c"] * n / facts["all"])) for r in alike.collect()} if near else {}
    # Ranges between cuts; a hot id has one of its own.
    splits = sorted(set(cuts) | set(hot) | {d + 1 for d in hot if d < (1 << 63) - 1})
    # Range 0 holds the largest ids, the last one those without; a range of one id has several parts by hash.
    parts = [1, *(hot.get(c, 1) for c in splits)][::-1] + [max(1, n * (facts["all"] - facts["with_id"]) // max(1, facts["all"]))]
    starts = [sum(parts[:k]) for k in range(len(parts))]
    zones_of = docs.sparkSession.createDataFrame(list(zip(range(len(parts)), starts, parts)), "range int, first int, parts int")
    # Doubles find the place among the cuts, longs decide among cuts of one double.
    bounds = sorted({float(c) for c in splits})
    same = [[c for c in splits if float(c) == x] for x in bounds]
    before = [sum(map(len, same[:k])) for k in range(len(same))]
    cut_of = docs.sparkSession.createDataFrame([(0.0, 0, []), *((float(k + 1), b, s) for k, (b, s) in enumerate(zip(before, same)))], "z double, before int, same array<long>")
    ranged = base.withColumn("x", F.col("d").cast("double"))
    ranged = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="x", outputCol="z", handleInvalid="keep").transform(ranged) if bounds else ranged.withColumn("z", F.lit(0.0))
    ranged = ranged.join(F.broadcast(cut_of), "z", "left").withColumn("z", F.col("before") + F.size(F.filter("same", lambda c: c <= F.col("d"))))
    last = len(splits)
    ranged = ranged.withColumn("range", F.when(F.col("d").isNull(), last + 1).otherwise(last - F.col("z")).cast("int"))
    # Hashes are even over their range, so parts of equal width hold about as many texts each.
    part = F.col("parts") - 1 - F.floor((F.shiftright("h", 32) + F.lit(1 << 31)) * F.col("parts") / F.lit(1 << 32))
    ranged = ranged.join(F.broadcast(zones_of), "range").withColumn("z", (F.col("first") + part).cast("int"))
    # One row per range: its first document in descending order, which is a guest at the end of the range before.
    order = F.struct(F.col("d").isNotNull(), F.col("d"), F.col("h"))
    heads = {r["z"]: r["o"] for r in ranged.groupBy("z").agg(F.max(order).alias("o")).collect()}
    zones = sorted(heads)
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not zones:
        return docs.sparkSession.createDataFrame([], kind)
    leads = docs.sparkSession.createDataFrame([(z, zones[i - 1], heads[z][1], heads[z][2]) for i, z in enumerate(zones)], "z int, prior int, lead long, mark long")
    own = F.struct(F.col("z").alias("z"), F.lit(0).alias("guest"))
    is_lead = F.col("d").eqNullSafe(F.col("lead")) & (F.col("h") == F.col("mark"))
    places = F.when(is_lead, F.array(own, F.struct(F.col("prior").alias("z"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    ranged = ranged.join(F.broadcast(leads), "z")
    rows = ranged.select("d", "t", "h", F.explode(places).alias("p")).select("p.z", "d", "t", "p.guest", "h").repartition("z")
    rows = rows.sortWithinPartitions("z", "guest", F.desc_nulls_last("d"), F.desc("h"))
    return rows.select("z", "d", "t", "guest").mapInArrow(lean(_pairs), kind)
