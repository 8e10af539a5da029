"""MinHash near-duplicates by an LSH forest (operator 6).

A document's set is its distinct word shingles; two documents are linked if
their sets' Jaccard similarity reaches the threshold, confirmed on the full
sets.  A component is what links connect; its smallest id is kept.

1. One pass over the texts gives each document its set's size, a 128-bit digest
   of the set and ``TREES`` * ``FIRST`` minimum hashes.  Rows of equal sets are one
   class with a number of its own from here on: exact copies cost one row, and two
   texts of one id are two nodes.  Ids come back when the classes are linked.
2. The forest: each tree reads the minimum hashes in its own order.  Its rows
   are sorted by range; documents that share the first ``FIRST`` hashes form a
   region.  At similarity 0.8 a pair misses all 24 regions with probability
   (1 - 0.8**5)**24 = 7e-5; of pairs that share one, later steps lose 3e-7 at
   that similarity (the estimate below) and none for any other reason.
3. Candidates in three rounds; each leaves out what already is one component.
   (a) All longest-common-prefix neighbours of all sorted orders.  (b) Adaptive
   depth: a region that still holds several components is descended hash by
   hash, and at every depth each part that holds several components has its
   members compared with its most central document.  So the depth at which a
   document finds its partner is that of its own surroundings.
   (c) What is still open.  A region of at most ``LEAF`` rows is a leaf of the
   forest: its pairs across components are candidates.  A larger one is too
   dense at every depth for its pairs and is searched around one centre, whole:
   each document is written as what it lacks of the centre's set (what most of
   its documents have) and what it has beside it; two that are linked while one
   of them is outside the main component share a shingle beside the centre, or
   the smaller overlap with the centre alone meets the need of both sizes.  The
   first meet in an index of the rarest such shingles (as many as the sizes and
   overlaps need), the second by steps of their size in the same index, and the
   two differences give the exact similarity without the texts.
   In (c) only rows outside the largest component of a leaf or of a run of the
   index probe the others, so rows of one component never meet.

Centres: the centre of a dense region is the one that most of its documents
have as the most central one of all their dense regions, so neighbouring
regions agree on a centre and a near copy is written against very few.

Sizes alone rule out pairs before any text moves; then, but for the index, the
share of equal minimum hashes, five standard deviations (probability 3e-7)
below the threshold.  Texts of documents that share a region are
shuffled; those of others are not read again.  Components are found by joins
(``components``).

Defined results: null or empty texts have an empty set and are linked with
nothing; null ids get no component and are kept; each row of a repeated id has
the component of its own text; an empty table gives an empty table; other
columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import settle, shuffle_width
from .words import SPACED, U, mix, signed, slices, words_of
from .workers import lean

TREES, FIRST, DEEP = 24, 5, 4
HASHES = TREES * FIRST
LEAF = 24
"""Rows of a leaf of the forest, whose pairs are candidates; larger regions are searched whole around a centre."""
_rng = np.random.default_rng(20240131)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.int64).astype(U)
_ODD = _rng.integers(0, 1 << 63, HASHES, dtype=np.int64).astype(U) << U(1) | U(1)


def shingles(array: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and each text's first place."""
    w = words_of(array, SPACED, fold=True)
    whole = w.whole(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    h = np.concatenate([w.grams(k)[whole], w.sequences()[short]])
    o = np.concatenate([w.owner()[whole], short])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(w.first)))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                h, first = shingles(batch.column(1), k)
                n = np.diff(first)
                some = np.flatnonzero(n)
                at = first[:-1][some]
                f, g, sig = np.zeros(len(n), U), np.zeros(len(n), U), np.zeros((len(n), HASHES), "<u4")
                if len(some):
                    f[some] = np.add.reduceat(mix(h), at)
                    g[some] = np.bitwise_xor.reduceat(mix(h * U(0x9E3779B97F4A7C15) + U(7)), at)
                    for j in range(HASHES):
                        sig[some, j] = np.minimum.reduceat((((h ^ _ADD[j]) * _ODD[j]) >> U(32)).astype(np.uint32), at)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, HASHES, 0))]).astype(np.int32)
                sigs = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig[n > 0].view("<i4").ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(signed(f)), pa.array(signed(g)), sigs, *batch.columns[2:]], ["d", "n", "f", "g", "sig", *batch.schema.names[2:]])

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        c, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sig = batch.column(2).flatten().to_numpy(zero_copy_only=False).view("<u4").reshape(-1, HASHES).astype(U)
        for t in range(TREES):
            order = sig[:, (np.arange(FIRST + DEEP) + t * FIRST) % HASHES]
            key = np.full(len(c), t + 1, U)
            for j in range(FIRST):
                key = mix(key * U(0x9E3779B97F4A7C15) + order[:, j])
            deep = [order[:, FIRST + j] << U(32) | order[:, FIRST + j + 1] for j in range(0, DEEP, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *(pa.array(signed(x)) for x in deep), pa.array(c), pa.array(n)], ["key", "x", "y", "c", "n"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in forest order: those whose region has others (or may have, at a batch's edges),
    each with the row before it in its region and that one's size, the number of rows seen of the
    region, and the keys of the deeper parts that it lies in, one hash longer each."""
    held: list[np.ndarray] | None = None

    def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, x, y, c, n = rows
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        keep = (size > 1) | (key == key[0]) | (key == key[-1])
        before = lambda a: pa.array(np.append(a[:1], a[:-1])[keep], mask=new[keep])
        part, parts = key[keep].view(U), []
        for h in (x[keep].view(U) >> U(32), x[keep].view(U), y[keep].view(U) >> U(32), y[keep].view(U)):
            part = mix(part * U(0x9E3779B97F4A7C15) + (h & U(0xFFFFFFFF)) + U(1))
            parts.append(part)
        parts = pa.FixedSizeListArray.from_arrays(pa.array(signed(np.stack(parts, 1).ravel())), DEEP).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(c[keep]), pa.array(n[keep]), before(c), before(n), pa.array(size[keep].astype(np.int64)), parts], ["key", "c", "n", "prev", "prev_n", "mates", "parts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(5)]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
        # The last row waits for its successor; a run's rows before it know their size or touch it.
        cut = len(rows[0]) - 1
        same = rows[0][:cut] == rows[0][cut] if cut else np.zeros(0, bool)
        cut = int(np.argmax(same)) if same.any() and same.sum() < 4096 else cut
        if cut:
            yield emit([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
    if held is not None:
        yield emit(held)


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 1 << 20):
                s, s_at = shingles(batch.column(2), k)
                t, t_at = shingles(batch.column(3), k)
                good = []
                for i in range(batch.num_rows):
                    x, y = s[s_at[i] : s_at[i + 1]], t[t_at[i] : t_at[i + 1]]
                    if len(x) > len(y):
                        x, y = y, x
                    both = 0
                    if len(x) and 100 * len(x) >= percent * len(y):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        both = int((y[at] == x).sum())
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                good = np.array(good, bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    return run


def _differences(k: int):
    """Per centre and document: their sizes, which of the centre's shingles the document lacks,
    and which it has beside the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3, 1 << 20):
                s, s_at = shingles(batch.column(3), k)
                t, t_at = shingles(batch.column(4), k)
                n, m, lacks, beside = [], [], [], []
                for i in range(batch.num_rows):
                    x, y = s[s_at[i] : s_at[i + 1]], t[t_at[i] : t_at[i + 1]]
                    n.append(len(x))
                    m.append(len(y))
                    lacks.append(signed(y[~np.isin(y, x, assume_unique=True)]))
                    beside.append(signed(x[~np.isin(x, y, assume_unique=True)]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(lacks, pa.list_(pa.int64())), pa.array(beside, pa.list_(pa.int64()))], ["p", "c", "component", "n", "m", "lacks", "beside"])

    return run


def _tagged(column: Column | str, kind: int) -> Column:
    return F.transform(column, lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("h")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, mark: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept (it is the row's own);
    ``mark`` names a long column that stays with its row, beside chosen: whether the row is the one
    document that stays of its component, one text of the smallest id (its repetitions are alike)."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), *([F.col(f"`{mark}`").cast("long").alias("mark")] if mark else []))
    signed_ = settle(base.mapInArrow(lean(_signatures(shingle)), "d long, n long, f long, g long, sig array<int>, h long" + ", mark long" * bool(mark)))
    # A class is found again by one of its rows, named by id and text; settling fixes its number.
    classes = signed_.where("n > 0 and d is not null").groupBy("f", "g", "n").agg(F.min(F.struct("d", "h")).alias("row"), F.first("sig").alias("sig"))
    nodes = settle(classes.withColumn("c", F.monotonically_increasing_id()))
    forest = nodes.select("c", "n", "sig").mapInArrow(lean(_trees), "key long, x long, y long, c long, n long")
    regions = forest.repartitionByRange(width, "key", "x", "y", "c").sortWithinPartitions("key", "x", "y", "c")
    regions = regions.mapInArrow(lean(_regions), "key long, c long, n long, prev long, prev_n long, mates long, parts array<long>")
    # The weight of a document is how much of the forest it shares, over its at most TREES rows.
    regions = settle(regions.withColumn("weight", F.sum("mates").over(Window.partitionBy("c"))).drop("mates"))
    wanted = nodes.select("c", "row.*").join(regions.select("c").distinct(), "c", "left_semi")
    texts = settle(base.select("d", "h", "text").join(wanted.hint("shuffle_hash"), ["d", "h"]).select("c", "text"))
    if texts.groupBy("c").count().where("count > 1").limit(1).count():  # repeated rows
        texts = settle(texts.groupBy("c").agg(F.first("text").alias("text")))
    alike = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    j = percent / 100
    least_equal = HASHES * j - 5 * math.sqrt(HASHES * j * (1 - j))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("c != p").select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        sigs = nodes.select("c", "sig")
        pairs = pairs.join(sigs.select(F.col("c").alias("a"), F.col("sig").alias("s")), "a").join(sigs.select(F.col("c").alias("b"), F.col("sig").alias("t")), "b")
        equal = F.aggregate(F.zip_with("s", "t", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
        pairs = pairs.where(equal >= least_equal).select("a", "b")
        with_b = pairs.join(texts.select(F.col("c").alias("b"), F.col("text").alias("t")), "b")
        with_a = with_b.join(texts.select(F.col("c").alias("a"), F.col("text").alias("s")), "a")
        return with_a.select("a", "b", "s", "t").mapInArrow(lean(_confirm(shingle, percent)), "a long, b long")

    def open_rows(found: DataFrame, *columns: str) -> DataFrame:
        """Rows of regions that hold several components, with their own component, and the region's
        largest one, number of rows and most central document."""
        rows = regions.select("key", "c", "n", "weight", *columns).join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
        per = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("weight", "c", "n", "component")).alias("hub"))
        of = per.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("rows"), F.max("hub").alias("hub"), F.count(F.lit(1)).alias("held"))
        return rows.join(of.where("held > 1").drop("held"), "key")

    # Round a: neighbours in the forest's orders.
    near = regions.where("prev is not null").select("c", "n", F.col("prev").alias("p"), F.col("prev_n").alias("m")).where(alike)
    tested = settle(ordered(near))
    links = settle(confirmed(tested))
    found = settle(components(links, links.count()))

    # Round b: hash by hash, every part of an open region against its most central document.
    levels = open_rows(found, "parts").select("c", "n", "component", "weight", F.explode(F.concat(F.array("key"), "parts")).alias("part"))
    levels = settle(levels)
    middle = levels.groupBy("part").agg(F.max(F.struct("weight", "c", "n", "component")).alias("h"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    middle = middle.select("part", F.col("h.c").alias("p"), F.col("h.n").alias("m"), F.col("h.component").alias("other"))
    stars = levels.join(middle, "part").where("component != other").where(alike).select("c", "p")
    pairs = settle(ordered(stars).join(tested, ["a", "b"], "left_anti"))
    tested = tested.union(pairs)
    links = settle(links.union(confirmed(pairs)))
    found = settle(components(links, links.count()))

    # Round c, leaves: their pairs across components; what is outside the largest one probes.
    rows = settle(open_rows(found))
    leaves = rows.where(F.col("rows") <= LEAF).select("key", "c", "n", "component", "main")
    mates = leaves.select("key", F.col("c").alias("p"), F.col("n").alias("m"), F.col("component").alias("other"))
    leaves = leaves.where("component != main").join(mates, "key").where("component != other").where(alike).select("c", "p")
    pairs = settle(ordered(leaves).join(tested, ["a", "b"], "left_anti"))

    # Round c, dense regions: each around the centre that most of its documents hold the most central.
    dense = rows.where(F.col("rows") > LEAF).select("key", "c", "n", "component", F.struct("hub.weight", "hub.c").alias("hub"))
    dense = dense.withColumn("lead", F.max("hub").over(Window.partitionBy("c")))  # at most TREES rows
    votes = dense.groupBy("key", "lead").agg(F.count(F.lit(1)).alias("k"))
    centres = votes.groupBy("key").agg(F.max(F.struct("k", "lead")).alias("v")).select("key", F.col("v.lead.c").alias("p"))
    members = settle(dense.join(centres, "key").where("c != p").select("p", "c", "component").distinct())
    members = members.join(texts.select("c", F.col("text").alias("s")), "c").join(texts.select(F.col("c").alias("p"), F.col("text").alias("t")), "p")
    units = settle(members.select("p", "c", "component", "s", "t").mapInArrow(lean(_differences(shingle)), "p long, c long, component long, n long, m long, lacks array<long>, beside array<long>"))
    # The centre's set becomes what most of its documents have: an edit of the centre's own is no difference of theirs.
    count = units.groupBy("p").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("low"))
    often = units.select("p", F.explode(F.concat(_tagged("lacks", 0), _tagged("beside", 1))).alias("e")).groupBy("p", "e.kind", "e.h").agg(F.count(F.lit(1)).alias("times"))
    often = often.join(count, "p").where("2 * times > members").groupBy("p").agg(*(F.collect_list(F.when(F.col("kind") == i, F.col("h"))).alias(x) for i, x in enumerate(("out", "into"))))
    none = F.array().cast("array<long>")
    turned = count.join(often, "p", "left").select("p", "low", F.coalesce("out", none).alias("out"), F.coalesce("into", none).alias("into"))
    units = units.join(turned, "p").select(
        "p", "c", "component", "low", "n", (F.col("m") - F.size("out") + F.size("into")).cast("long").alias("m"), (F.col("n") - F.size("beside")).alias("to_p"), F.col("m").alias("n_p"),
        F.concat(F.array_except("lacks", "out"), F.array_except("into", "beside")).alias("lacks"), F.concat(F.array_except("beside", "into"), F.array_except("out", "lacks")).alias("beside"),
    )
    units = settle(units.withColumn("o", F.col("n") - F.size("beside")))
    # A partner of size b or more shares need(n + b) shingles, of which at most the overlap lie in
    # the centre.  Of r shingles that two must share, one is among all but r - 1 of either's, rarest first.
    least = F.greatest("low", F.ceil(percent * F.col("n") / 100))
    need = F.ceil(percent * (F.col("n") + least) / (100 + percent))
    first = F.size("beside") - F.greatest(F.lit(1), need - F.col("o")) + 1
    # Two without such a shingle lie in the centre each but for a share of the threshold, and in one
    # or two neighbouring steps of size.
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(max(100 / percent, 1.1)))
    steps = F.when(100 * F.col("o") >= percent * F.col("n"), F.array(step, step + 1)).otherwise(none)
    entries = F.concat(_tagged("beside", 1), _tagged(steps, 0))
    index = units.select("p", "c", "component", "n", "o", (first + F.size(steps)).alias("first"), F.explode(entries).alias("e")).select("p", "c", "component", "n", "o", "first", "e.*")
    per = index.groupBy("p", "kind", "h", "component").agg(F.count(F.lit(1)).alias("k"))
    runs = per.groupBy("p", "kind", "h").agg(F.sum("k").alias("times"), F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("held"))
    rank = F.row_number().over(Window.partitionBy("p", "c").orderBy("kind", "times", "h"))
    rare = settle(index.join(runs, ["p", "kind", "h"]).withColumn("rank", rank).where("rank <= first and held > 1").select("p", "kind", "h", "c", "component", "n", "o", "main"))
    mates = rare.select("p", "kind", "h", F.col("c").alias("c2"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("o").alias("o2"))
    met = rare.where("component != main").join(mates, ["p", "kind", "h"]).where("component != other").where(alike)
    met = met.where(f"kind = 1 or least(o, o2) * {100 + percent} >= {percent} * (n + m)").select("p", "c", "c2").distinct()
    known = units.select("p", "c", "n", "m", "lacks", "beside")
    both = met.join(known, ["p", "c"]).join(known.select("p", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "lacks", "beside")]), ["p", "c2"])
    common = F.col("m") - F.size(F.array_union("lacks", "lacks2")) + F.size(F.array_intersect("beside", "beside2"))
    exact = both.withColumn("o", common).where(f"o > 0 and 100 * o >= {percent} * (n + n2 - o)").select("c", F.col("c2").alias("p"))
    central = units.where(f"to_p > 0 and 100 * to_p >= {percent} * (n + n_p - to_p)").select("c", "p")

    links = settle(links.union(confirmed(pairs)).union(ordered(exact.union(central))))
    found = components(links, links.count())

    # Classes back to ids: a component's head is the first row, by id and text, of all its classes.
    rows = signed_.drop("sig").join(nodes.select("f", "g", F.col("n").alias("m"), "c", "row"), ["f", "g"], "left").where("m is null or m = n")
    linked = settle(found.select(F.col("node").alias("c"), "component").union(found.select(F.col("component").alias("c"), "component").distinct()))
    heads = linked.join(nodes.select("c", "row"), "c").groupBy("component").agg(F.min("row").alias("head"))
    rows = rows.join(linked.join(heads, "component").select("c", "head"), "c", "left").withColumn("head", F.coalesce("head", "row"))
    ids = F.when(F.col("n") > 0, F.col("head.d")).otherwise(F.col("d"))
    out = rows.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("d").isNotNull(), ids).alias("component_id"), *([F.col("mark").alias(mark), (F.col("d").isNull() | F.coalesce(F.col("head") == F.struct("d", "h"), F.lit(True))).alias("chosen")] if mark else []))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
