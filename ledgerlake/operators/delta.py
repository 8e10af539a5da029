"""Block signatures, duplicate blocks, and delta plans between two versions of a file.

Files are cut into fixed blocks of their bytes; the weak hash is the rolling
checksum, the strong one SHA-256.  Aligned and moved blocks are found by equi
joins on hashes, blocks at any offset in ranges of a file, many tasks a file."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..shared import settle
from ..shipping import ship

MOD = 65521
"""Fixed value: the modulus of both halves of the weak hash."""


def blocks(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per block: index, its bytes and strong hash.  A slice of bytes costs its own length."""
    rows = files.select(*keys, F.encode(content, "UTF-8").alias("_data"))
    rows = rows.withColumn("block_size", fn.block_size(F.octet_length("_data")))
    n = F.ceil(F.octet_length("_data") / F.col("block_size"))
    rows = rows.withColumn("index", F.explode(F.when(F.octet_length("_data") > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))))
    block = F.substring(F.col("_data"), (F.col("index") * F.col("block_size") + 1).cast("int"), F.col("block_size").cast("int"))
    return rows.select(*keys, "index", "block_size", block.alias("block")).withColumn("strong", F.sha2("block", 256))


def weak_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The weak hash of every window of ``width`` bytes, from prefix sums."""
    x = data.astype(np.int64)
    s, t = (np.concatenate([[0], np.cumsum(v)]) for v in (x, x * np.arange(len(x))))
    at = np.arange(len(x) - width + 1)
    a = s[width:] - s[: len(at)]
    b = (at + width) * a - (t[width:] - t[: len(at)])
    return (b % MOD) << 16 | a % MOD


def signatures(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Per block its index, weak and strong hash."""
    rows = blocks(files, keys, content).select("block", F.struct(*keys, "index", "strong").alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak = [int(weak_hashes(np.frombuffer(b.as_py(), np.uint8), len(b.as_py()))[0]) for b in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(weak, pa.int64())], ["rest", "weak"])

    ship(files.sparkSession)
    return rows.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, weak long").select("rest.*", "weak")


def weak_blocks(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Per block its index, length and weak hash, for whole files at once; no block leaves its row."""
    rows = files.select(F.encode(content, "UTF-8").alias("data"), F.struct(*keys).alias("rest"))
    rows = rows.withColumn("size", fn.block_size(F.octet_length("data")).cast("long"))
    each = "array<struct<index:long,bytes:long,weak:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, size = batch.column(0)[k].as_py() or b"", batch.column(2)[k].as_py()
                whole = len(data) // size if data else 0
                weak = block_hashes(data, size)
                found = [{"index": i, "bytes": size if i < whole else len(data) - i * size, "weak": int(w)} for i, w in enumerate(weak)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1), pa.array([found], pa.list_(pa.struct([("index", pa.int64()), ("bytes", pa.int64()), ("weak", pa.int64())])))], ["rest", "blocks"])

    ship(files.sparkSession)
    out = rows.select("data", "rest", "size").mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, blocks {each}")
    return out.select("rest.*", F.explode("blocks").alias("b")).select(*keys, "b.*")


def block_hashes(data: bytes, size: int) -> np.ndarray:
    """The weak hash of each block of a file, the last one as long as it is."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    first = np.arange(0, len(x), size)
    if not len(first):
        return np.zeros(0, np.int64)
    length = np.minimum(size, len(x) - first)
    a = np.add.reduceat(x, first)
    b = np.repeat(first + length, length)
    b = np.add.reduceat((b - np.arange(len(x))) * x, first)
    return (b % MOD) << 16 | a % MOD


def block_dedup(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Distinct blocks by how often they occur, and what duplicates would save; ``keys`` name a file.

    Two stages: blocks are grouped by length and weak hash, from one pass over the files.  A block
    whose weak hash is alone is distinct as it is; only those that share one are cut out again and
    told apart by their strong hash."""
    weak = settle(weak_blocks(files, keys, content))
    per = settle(weak.groupBy("bytes", "weak").agg(F.count(F.lit(1)).alias("n")))
    shared = per.where("n > 1").select("bytes", "weak")
    again = candidates(files, weak.join(shared, ["bytes", "weak"], "left_semi"), keys, content)
    strong = again.groupBy("strong").agg(F.count(F.lit(1)).alias("copies"), F.first("bytes").alias("bytes"))
    alone = per.where("n = 1").select(F.lit(1).cast("long").alias("copies"), "bytes")
    per = strong.select("copies", "bytes").union(alone)
    return per.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("blocks"), F.count(F.lit(1)).alias("distinct_blocks"), F.coalesce(F.sum(F.col("copies") * F.col("bytes")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("distinct_bytes"))


def candidates(files: DataFrame, wanted: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The strong hash of the ``wanted`` blocks (keys, index, bytes) alone."""
    per = wanted.groupBy(*keys).agg(F.collect_list(F.struct("index", "bytes")).alias("_wanted"))
    data = F.encode(content, "UTF-8")
    rows = files.join(per, keys).select(*keys, data.alias("_data"), fn.block_size(F.octet_length(data)).alias("_size"), F.explode("_wanted").alias("w"))
    block = F.substring(F.col("_data"), (F.col("w.index") * F.col("_size") + 1).cast("int"), F.col("w.bytes").cast("int"))
    return rows.select(*keys, "w.*", F.sha2(block, 256).alias("strong"))


def aligned_plan(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per pair, block by block: an equal block at the same place is preferred to a moved one; the rest is literal."""
    o, n = blocks(old, [key]), blocks(new, [key])
    here = o.select(key, "index", F.col("strong").alias("_s"), F.col("block_size").alias("_b"))
    anywhere = o.groupBy(key, "strong").agg(F.min("index").alias("_from"))
    j = n.join(here, [key, "index"], "left").join(anywhere, [key, "strong"], "left")
    aligned = F.coalesce(F.col("strong") == F.col("_s"), F.lit(False))
    return j.select(key, "index", F.when(aligned, F.col("index")).otherwise(F.col("_from")).alias("from_block"), F.when(aligned, "aligned").when(F.col("_from").isNotNull(), "moved").otherwise("literal").alias("token"), F.octet_length("block").alias("bytes"))


def plan_totals(tokens: DataFrame, key: str) -> DataFrame:
    hit = F.col("token") != "literal"
    return tokens.groupBy(key).agg(F.count_if(hit).alias("matched_blocks"), F.coalesce(F.sum(F.when(~hit, F.col("bytes"))), F.lit(0)).cast("long").alias("literal_bytes"), F.sum("bytes").cast("long").alias("total_bytes"))


RANGE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` bytes, equal for equal windows at any place."""
    n = len(data) - width + 1
    power = np.full(len(data) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return ((total[width:] - total[:n]) * back[:n]).view(np.int64)


def jumps(places: np.ndarray, size: int, at: int) -> list[int]:
    """The places chosen from ``at`` on, left to right: the next one that no chosen block covers."""
    out = []
    i = int(np.searchsorted(places, at))
    while i < len(places):
        out.append(int(places[i]))
        i = int(np.searchsorted(places, places[i] + size))
    return out


def _ranged(pairs: DataFrame, key: str, new: str) -> DataFrame:
    """New files in ranges of at least ``RANGE_BYTES`` with what a window may reach beyond them."""
    rows = pairs.select(key, "size", F.encode(new, "UTF-8").alias("_data"))
    span = F.greatest(F.col("size"), F.lit(RANGE_BYTES))
    rows = rows.withColumn("span", span).withColumn("n", F.octet_length("_data").cast("long"))
    rows = rows.where("n >= size").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - F.col("size")) / F.col("span")))))
    part = F.substring(F.col("_data"), (F.col("r") * F.col("span") + 1).cast("int"), (F.col("span") + F.col("size") - 1).cast("int"))
    return rows.select(key, "r", "size", "span", part.alias("part"))


def _hits(second: Callable[[np.ndarray, int], np.ndarray]):
    """Of each range the places whose window has the weak hash, and then the second hash, of a block,
    and where the next range is entered: for each entry that makes a difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, size, span = np.frombuffer(row["part"], np.uint8), row["size"], row["span"]
                where = np.flatnonzero(np.isin(weak_hashes(data, size), np.array(row["weak"], np.int64)))
                if len(where):
                    where = where[np.isin(second(data, size)[where], np.array(row["second"], np.int64))]
                if row["wrong"]:
                    where = np.setdiff1d(where, np.array(row["wrong"], np.int64) - row["r"] * span)
                enter, leave = [], []
                for p in [*where[where < size].tolist(), size - 1]:
                    chosen = jumps(where, size, p)
                    enter.append(p)
                    leave.append(max(chosen[-1] + size - span, 0) if chosen else 0)
                    if len(leave) > 1 and leave[-1] == leave[-2]:
                        enter.pop(-2), leave.pop(-2)
                yield pa.RecordBatch.from_pylist([{"key": row["key"], "r": row["r"], "places": where.tolist(), "enter": enter, "leave": leave}], schema=_HITS)

    return run


_HITS = pa.schema([("key", pa.int64()), ("r", pa.int64()), ("places", pa.list_(pa.int64())), ("enter", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64()))])


def _entries(table: pa.Table) -> pa.Table:
    """Where each range of a file is entered; ranges are rows of a few numbers."""
    table = table.sort_by("r")
    at, out = 0, []
    for enter, leave in zip(table.column("enter").to_pylist(), table.column("leave").to_pylist()):
        out.append(at)
        i = int(np.searchsorted(enter, at))
        at = leave[i] if i < len(enter) else 0
    return pa.table({"key": table.column("key"), "r": table.column("r"), "at": pa.array(out, pa.int64())})


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            start = row["r"] * row["span"]
            found = jumps(np.array(row["places"], np.int64), row["size"], row["at"])
            strong = [hashlib.sha256(row["part"][p : p + row["size"]]).hexdigest() for p in found]
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(found), pa.int64()), pa.array([start + p for p in found], pa.int64()), pa.array(strong, pa.string())], ["key", "place", "strong"])


def shifted_tokens(pairs: DataFrame, key: str, old: str = "old", new: str = "new", second: Callable[[np.ndarray, int], np.ndarray] = window_hashes) -> DataFrame:
    """(key, place, block): blocks of ``old`` found at any byte of ``new``, chosen left to right.

    Pairs of files of at most ``RANGE_BYTES`` each are matched where they lie, without a shuffle;
    larger ones in ranges, many tasks a file.  A block at its own place is preferred to others of
    the same content, else the first."""
    pairs = pairs.select(F.col(key).cast("long").alias("key"), F.coalesce(old, F.lit("")).alias("old"), F.coalesce(new, F.lit("")).alias("new")).withColumn("size", fn.block_size(F.octet_length("old")).cast("long"))
    ship(pairs.sparkSession)
    large = F.greatest(F.octet_length("old"), F.octet_length("new")) > RANGE_BYTES
    found = pairs.where(~large).select("key", "size", F.encode("old", "UTF-8").alias("old"), F.encode("new", "UTF-8").alias("new")).mapInArrow(_matched, "key long, place long, size long, block long")
    rest = settle(pairs.where(large))
    return found if rest.isEmpty() else found.unionByName(_ranged_tokens(rest, second))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each old file in its new one: windows of a block's weak hash are compared with
    the old blocks themselves, and one that differs from all of them is passed over."""
    for batch in batches:
        keys, places, sizes, chosen = [], [], [], []
        for row in zip(*batch.columns):  # one pair at a time as Python bytes
            key, size, old, new = (x.as_py() for x in row)
            many = len(old) // size
            if not many or len(new) < size:
                continue
            first: dict[bytes, int] = {}
            for i in range(many):
                first.setdefault(old[i * size : (i + 1) * size], i)
            known = np.unique(block_hashes(old[: many * size], size))
            weak = weak_hashes(np.frombuffer(new, np.uint8), size)
            where = np.flatnonzero(known[np.minimum(np.searchsorted(known, weak), len(known) - 1)] == weak)
            i, begun = 0, len(places)
            while i < len(where):
                at = int(where[i])
                part = new[at : at + size]
                block = first.get(part)
                if block is None:
                    i += 1
                    continue
                own = at // size
                if at % size == 0 and own < many and old[at : at + size] == part:
                    block = own
                places.append(at)
                chosen.append(block)
                i = int(np.searchsorted(where, at + size))
            keys += [key] * (len(places) - begun)
            sizes += [size] * (len(places) - begun)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, places, sizes, chosen)], ["key", "place", "size", "block"])


def _ranged_tokens(pairs: DataFrame, second: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``shifted_tokens`` of large files (key, old, new, size).

    A new file is many ranges, each a row with the reach of one block beyond it, so that every
    window lies in one.  A range finds its places by weak hash and then by a second rolling hash;
    for every way of entering it, it knows where the next one is entered, and a file's entries
    follow from those few numbers.  Chosen places are confirmed by SHA-256; one that the hashes
    have wrongly suggested is struck out and the choice made again."""
    blocks_ = settle(_whole_blocks(pairs, second))
    known = blocks_.groupBy("key").agg(F.collect_set("weak").alias("weak"), F.collect_set("second").alias("second"))  # the square root of a file's bytes
    ranges = settle(_ranged(pairs, "key", "new").join(known, "key").repartition(F.col("key"), F.col("r")))
    schema = "key long, r long, places array<long>, enter array<long>, leave array<long>"
    wrong = pairs.sparkSession.createDataFrame([], "key long, place long")
    while True:
        struck = ranges.select("key", "r", "span").join(wrong, "key").where("place between r * span and (r + 2) * span").groupBy("key", "r").agg(F.collect_list("place").alias("wrong"))
        hits = settle(ranges.join(struck, ["key", "r"], "left").mapInArrow(_hits(second), schema))
        entries = hits.select("key", "r", "enter", "leave").groupBy("key").applyInArrow(_entries, "key long, r long, at long")
        rows = ranges.drop("weak", "second").join(hits.select("key", "r", "places"), ["key", "r"]).join(entries, ["key", "r"])
        found = settle(rows.mapInArrow(_chosen, "key long, place long, strong string"))
        which = blocks_.groupBy("key", "strong").agg(F.min("index").alias("first"))
        own = blocks_.select("key", F.col("strong").alias("own"), F.col("index").alias("_i"))
        size = pairs.select("key", "size").distinct()
        found = found.join(size, "key").withColumn("_i", F.when(F.col("place") % F.col("size") == 0, F.floor(F.col("place") / F.col("size"))))
        found = settle(found.join(which, ["key", "strong"], "left").join(own, ["key", "_i"], "left").select("key", "place", "size", F.when(F.col("own") == F.col("strong"), F.col("_i")).otherwise(F.col("first")).alias("block")))
        bad = found.where("block is null").select("key", "place")
        if not bad.limit(1).count():
            return found
        wrong = settle(wrong.union(bad))


def _whole_blocks(pairs: DataFrame, hashes: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """Whole blocks of the old files: index, both rolling hashes and SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, size = row["data"], row["size"]
                many = len(data) // size
                parts = [data[i * size : (i + 1) * size] for i in range(many)]
                second = [int(hashes(np.frombuffer(p, np.uint8), size)[0]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * many, pa.int64()), pa.array(range(many), pa.int64()), pa.array(block_hashes(data[: many * size], size)), pa.array(second, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())], ["key", "index", "weak", "second", "strong"])

    return pairs.select("key", "size", F.encode("old", "UTF-8").alias("data")).mapInArrow(run, "key long, index long, weak long, second long, strong string")


def shifted_plan(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """Totals of ``shifted_tokens`` and of the old file's rest at the new one's end, per pair.
    The ends are compared where the texts are; only numbers are joined."""
    found = shifted_tokens(pairs, key, old, new).groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"), F.max(F.col("place") + F.col("size")).alias("_at"))
    o, n = (F.encode(F.coalesce(c, F.lit("")), "UTF-8") for c in (old, new))
    rows = pairs.select(F.col(key).cast("long").alias("key"), o.alias("o"), n.alias("n"), fn.block_size(F.octet_length(o)).cast("long").alias("size"))
    rows = rows.withColumn("rest", (F.octet_length("o") % F.col("size")).cast("int")).withColumn("total", F.octet_length("n").cast("long"))
    tail = lambda c: F.expr(f"substring({c}, cast(octet_length({c}) - rest + 1 as int), rest)")
    same = (F.col("rest") > 0) & (F.col("total") >= F.col("rest")) & (tail("o") == tail("n"))
    rows = rows.select("key", "rest", "total", same.alias("same"))
    rows = rows.join(found, "key", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("_n", "_bytes", "_at")})
    ends = F.col("same") & (F.col("total") - F.col("rest") >= F.col("_at"))
    return rows.select(F.col("key").alias(key), (F.col("_n") + ends.cast("long")).alias("matched_blocks"), (F.col("total") - F.col("_bytes") - F.when(ends, F.col("rest")).otherwise(0)).alias("literal_bytes"), F.col("total").alias("total_bytes"))


def rebuild(tokens: DataFrame, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Whether each new text follows from its aligned plan: every part that the plan takes from the
    old text or as literal is the new text's own at its place, and together they are as long.
    Parts are compared where they are; no file is put together in one row."""
    basis = blocks(old, [key]).select(key, F.col("index").alias("from_block"), F.col("block").alias("_old"))
    literal = blocks(new, [key]).select(key, "index", F.col("block").alias("_new"))
    parts = tokens.join(basis, [key, "from_block"], "left").join(literal, [key, "index"])
    part = F.when(F.col("token") == "literal", F.col("_new")).otherwise(F.col("_old"))
    per = parts.groupBy(key).agg(F.bool_and(F.coalesce(part == F.col("_new"), F.lit(False))).alias("_same"), F.sum(F.octet_length(part)).alias("_bytes"))
    whole = new.select(key, F.coalesce(F.octet_length("content"), F.lit(0)).alias("_length")).join(per, key, "left")
    return whole.select(key, (F.coalesce("_same", F.lit(True)) & (F.coalesce("_bytes", F.lit(0)) == F.col("_length"))).alias("verified"))
