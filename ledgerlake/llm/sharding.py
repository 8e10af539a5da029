"""Sharding by longest processing time (operator 10), law ``bytes``.

Equal texts form a group that stays together.  Groups, largest first, go to the
least-loaded shard through a heap.

Scale: groups of equal size are interchangeable, so only the histogram of group
sizes reaches the driver.  Different sizes add up to no more than all bytes, so
there are at most sqrt(2 * bytes) of them, however many groups there are; a run
of equal groups is dealt through the heap in one step, with the very shards
that one by one would give.  A group then finds its shard by its rank among the
groups of its size: a rank per size and hash bucket plus the bucket's offset,
so a size that a third of all groups share is ranked in many tasks.  The texts
are read once; sizes are added up before any shuffle, so a text that a third of
all rows repeat is one row a task.  Slots are gapless within a shard in the
same way: rows are dealt to buckets by their place in the input, so neither a
shard nor a row that repeats is ranked in one task.

Law: sizes near equal; a group larger than a shard's share fills one alone.
Defined results: a null text has no bytes and groups with the empty text; null
ids and repeated rows are placed like others; an empty table gives no rows;
other columns are dropped.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import settle, shared_folder, shuffle_width

CHUNK = 20_000


def _fill(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard takes until at most one a shard are
    left: items go to the smallest loads, so those below a common level are taken."""
    if max(loads) - min(loads) < size:
        return [count // len(loads)] * len(loads)  # whole rounds
    level = lambda top: [max(0, -((load - top) // size)) for load in loads]
    low, high = min(loads), min(loads) + size * count + 1
    while high - low > 1:
        top = (low + high) // 2
        low, high = (top, high) if sum(level(top)) <= count else (low, top)
    return level(low)


def dealt(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each group size, largest first, how many of its groups go to each shard: each to the
    least-loaded shard (of equals the first).  Only the heap of loads is kept."""
    heap = [(0, s) for s in range(shards)]
    for size, left in sizes:
        taken = [0] * shards
        if left > shards:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            taken = _fill(loads, size, left)
            left -= sum(taken)
            heap = [(load + size * n, s) for s, (load, n) in enumerate(zip(loads, taken))]
            heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            taken[s] += 1
        yield size, taken


def deal(histogram: dict[int, int], shards: int) -> dict[int, list[int]]:
    return dict(dealt(sorted(histogram.items(), reverse=True), shards))


def _ends(histogram: DataFrame, shards: int) -> DataFrame:
    """Up to which rank the groups of a size go to each shard.  Sizes pass the driver in descending
    order, a partition at a time, and leave it in parts of ``CHUNK`` rows."""
    spark = histogram.sparkSession
    where, schema = f"{shared_folder(spark)}/ends-{uuid.uuid4().hex}", "bytes long, upto array<long>"
    sizes = ((r["bytes"], r["n"]) for r in histogram.orderBy(F.desc("bytes")).toLocalIterator())
    rows = ((size, list(accumulate(taken))) for size, taken in dealt(sizes, shards))
    made = False
    while part := list(islice(rows, CHUNK)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
        made = True
    return spark.read.schema(schema).parquet(where) if made else spark.createDataFrame([], schema)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and grown_shard (null)."""
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # The bucket is set by the place in the input, and kept: ranks and offsets read the same rows.
    rows = settle(docs.select(F.col(f"`{id_col}`").alias("d"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("g"), F.pmod(F.monotonically_increasing_id(), F.lit(width)).alias("sub")))

    def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
        """Rows with a gapless ``rank`` within their key, from one rank per key and bucket."""
        counts = df.groupBy(key, "sub").agg(F.count(F.lit(1)).alias("n"))
        before = counts.select(key, "sub", (F.sum("n").over(Window.partitionBy(key).orderBy("sub")) - F.col("n")).alias("before"))
        inside = F.row_number().over(Window.partitionBy(key, "sub").orderBy(*order)) - 1
        return df.withColumn("inside", inside).join(before, [key, "sub"]).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "sub")

    groups = settle(rows.groupBy("g").agg(F.sum("size").alias("bytes")).withColumn("sub", F.pmod(F.xxhash64("g"), F.lit(width))))
    ends = _ends(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), shards)
    place = F.size(F.filter("upto", lambda x: x <= F.col("rank"))).cast("int")
    homes = ranked(groups, "bytes", ["g"]).join(ends, "bytes").select("g", place.alias("shard"))
    placed = ranked(settle(rows.join(homes, "g")), "shard", ["d", "g"])
    return placed.select(F.col("d").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
