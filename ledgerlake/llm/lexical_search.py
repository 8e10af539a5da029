"""Ranked lexical search of all documents for each query item (operator 12).

Terms are runs of ASCII letters and digits and of characters above ASCII, A-Z
lower-cased.  Scores are a BM25 kind in whole numbers: a term weighs
``floor(1000 * ln((2N + 2) / (2 df + 1)))``, a document of n terms has the norm
``m = 50 + 50 n N div L``, and a term that it holds tf times adds
``weight * (10**9 tf div (1000 tf + 20 m))``.

Method (hybrid TAAT-DAAT, in blocks of documents): a block holds the postings of
the query terms in document order.  For an item, the short lists are added up
term at a time into accumulators, which then are one more iterator with a bound
of their own beside the long lists.  All of them are walked document at a time:
the next stop is the next interval of 64 documents whose bounds together reach
the threshold (the k-th best score so far), lists skip what lies between, and
the documents of that interval are scored at once.  Accumulators and the best
postings of single lists set the first threshold, which later blocks of a task
inherit.  Every bound is an upper bound and ties are kept, so the ranking is exact.

Scale: texts are read once for each ``QUERY_BYTES`` of item terms (one pass for
queries of the usual size; what is broadcast never outgrows that bound, or one
item), into rows of a document's query terms alone, written to the shared
folder.  Document counts come from those rows; both passes are narrow.  Each
task returns its k best of each item; they are ranked in groups of tasks first
and then per item.

Defined results: a null text has no terms; rows are documents of their own, with
an id that is null or repeated too (rank then follows score and id, nulls last);
items of one id (null too) are one item with all their terms; items without a
term that any document holds, or an empty table, give no rows; other columns
play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import settle, shuffle_width
from .words import ALNUM, slices, words_of
from .workers import lean

QUERY_BYTES = 8 << 20
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 21
INTERVAL, STOPS = 64, 16
SHORT = 32
"""A list is short if it has fewer than one document in so many of the block."""
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Vocabulary:
    """The query terms of a block of items by the hash of their bytes."""

    def __init__(self, terms: list[str]) -> None:
        w = words_of(pa.array(terms, pa.string()), ALNUM)
        self.order = np.argsort(w.hashes, kind="stable")
        self.hashes = w.hashes[self.order]
        self.raw, self.starts, self.sizes = w.raw, w.starts, w.ends - w.starts
        self.alike = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))

    def find(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and the terms' numbers; bytes decide, not hashes."""
        at = np.searchsorted(self.hashes, w.hashes)
        places, numbers = [], []
        for k in range(self.alike):
            slot = np.minimum(at + k, len(self.order) - 1)
            place = np.flatnonzero(self.hashes[slot] == w.hashes)
            term = self.order[slot[place]]
            size = w.ends[place] - w.starts[place]
            fits = size == self.sizes[term]
            place, term, size = place[fits], term[fits], size[fits]
            if len(place):
                first = np.cumsum(size) - size
                step = np.arange(int(size.sum())) - np.repeat(first, size)
                same = w.raw[np.repeat(w.starts[place], size) + step] == self.raw[np.repeat(self.starts[term], size) + step]
                fits = np.logical_and.reduceat(same, first)
                places.append(place[fits])
                numbers.append(term[fits])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *numbers])


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _forward(terms):
    """Each document's number of terms, and its query terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms.value)
        many = len(terms.value)
        for whole in batches:
            for batch in slices(whole, 1):
                w = words_of(batch.column(1), ALNUM, fold=True)
                place, term = vocabulary.find(w)
                held, tf = np.unique(w.owner()[place] * many + term, return_counts=True)
                ends = np.searchsorted(held // many, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts.astype(np.int64)), _lists((held % many).astype(np.int32), ends), _lists(tf.astype(np.int64), ends)], ["doc_id", "n", "terms", "tfs"])

    return run


def norms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 50 + ((50 n N) div L) of each document."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        return 50 + (50 * documents * n) // total
    return np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)


class Block:
    """The postings of a block of documents, term by term in document order."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray, documents: int, total: int) -> None:
        self.many = len(n)
        self.intervals = -(-self.many // INTERVAL)
        order = np.argsort(terms, kind="stable")
        doc = np.repeat(np.arange(self.many), sizes)[order]
        term, tf = terms[order], tfs[order]
        self.doc = doc
        self.score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norms(n, documents, total)[doc]))
        present, first = np.unique(term, return_index=True)
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(present, first, [*first[1:], len(term)])}
        self.known: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def long_list(self, t: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where each interval of a list begins, its best score there, and its k-th best score."""
        if t not in self.known:
            a, b = self.lists[t]
            doc, score = self.doc[a:b], self.score[a:b]
            begins = a + np.searchsorted(doc, np.arange(self.intervals + 1) * INTERVAL)
            best = np.zeros(self.intervals, np.int64)
            np.maximum.at(best, doc // INTERVAL, score)
            self.known[t] = begins, best, int(np.partition(score, b - a - k)[b - a - k]) if b - a >= k else 0
        return self.known[t]

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for these terms with ``least`` or more, and their scores."""
        spans = {t: self.lists[t] for t in terms.tolist() if t in self.lists}
        brief = [t for t, (a, b) in spans.items() if (b - a) * SHORT < self.many]
        sums = np.zeros(self.intervals * INTERVAL, np.int64)
        for t in brief:  # term at a time
            a, b = spans[t]
            sums[self.doc[a:b]] += self.score[a:b]
        sums = sums.reshape(-1, INTERVAL)
        bound = sums.max(1)
        if np.count_nonzero(sums) >= k:
            least = max(least, int(np.partition(sums, sums.size - k, axis=None)[sums.size - k]))
        lists = [(*self.long_list(t, k), *spans[t]) for t in spans if t not in set(brief)]
        for _, best, kth, _, _ in lists:
            bound = bound + best
            least = max(least, kth)
        least = max(least, 1)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        stops = np.flatnonzero(bound >= least)
        while len(stops):  # document at a time: intervals in order, lists skip to the next stops
            now, stops = stops[:STOPS], stops[STOPS:]
            score = sums[now]
            for begins, _, _, _, _ in lists:
                size = begins[now + 1] - begins[now]
                at = np.repeat(begins[now] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                score[np.repeat(np.arange(len(now)), size), self.doc[at] % INTERVAL] += self.score[at]
            row, place = np.nonzero(score >= least)
            docs = np.concatenate([docs, now[row] * INTERVAL + place])
            scores = np.concatenate([scores, score[row, place]])
            if len(docs) > k:
                keep = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[keep], scores[keep]
            if len(docs) == k:
                least = max(least, int(scores.min()))
                stops = stops[bound[stops] >= least]
        return docs, scores


def _search(query, k: int, documents: int, total: int, id_type: pa.DataType):
    """The k best documents of a task for each item, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ends, terms, weight = query.value
        floor = np.zeros(len(items), np.int64)
        top = pa.table({"item": pa.array([], pa.int64()), "doc_id": pa.array([], id_type), "score": pa.array([], pa.int64())})

        def flush(rows: list[pa.RecordBatch]) -> None:
            nonlocal top
            block = pa.Table.from_batches(rows)
            block = block.take(pc.sort_indices(block, [("doc_id", "ascending")])).combine_chunks()
            column = {c: block.column(c).chunk(0) for c in block.column_names}
            index = Block(column["n"].to_numpy(), pc.list_value_length(column["terms"]).to_numpy(zero_copy_only=False), column["terms"].flatten().to_numpy(), column["tfs"].flatten().to_numpy(), weight, documents, total)
            found = [index.best(terms[ends[i] : ends[i + 1]], k, int(floor[i])) for i in range(len(items))]
            size = np.array([len(d) for d, _ in found])
            docs, scores = (np.concatenate([f[j] for f in found]) for j in (0, 1))
            new = pa.table({"item": np.repeat(np.arange(len(items)), size), "doc_id": column["doc_id"].take(pa.array(docs)), "score": scores})
            top = pa.concat_tables([top, new])
            top = top.take(pc.sort_indices(top, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
            item, score = top.column("item").to_numpy(), top.column("score").to_numpy()
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            last = rank == k - 1
            floor[item[last]] = score[last]
            top = top.filter(pa.array(rank < k)).combine_chunks()

        rows, docs, postings = [], 0, 0
        for whole in batches:
            held = np.cumsum(pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(held):
                before = held[at - 1] if at else 0
                stop = min(max(at + 1, int(np.searchsorted(held, before + BLOCK_POSTINGS - postings, side="right"))), at + BLOCK_DOCS - docs)
                rows.append(whole.slice(at, stop - at))
                docs, postings = docs + stop - at, postings + int(held[stop - 1] - before)
                at = stop
                if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    flush(rows)
                    rows, docs, postings = [], 0, 0
        if rows:
            flush(rows)
        for batch in top.to_batches():
            yield pa.RecordBatch.from_arrays([items.take(batch.column(0)), batch.column(1), batch.column(2)], ["item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents (item_id, rank, doc_id, score) of each item, scores above 0, ties by id."""
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.translate(F.col(f"`{item_text}`"), UPPER, LOWER), F.lit(TERM), F.lit(1))
    wanted = settle(items.select(F.col(f"`{item_col}`").alias("item_id"), F.explode(words).alias("term")).distinct())
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("s")).head()["s"]
    blocks = max(1, -(-size // QUERY_BYTES))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kinds = texts.schema["doc_id"].dataType.simpleString(), wanted.schema["item_id"].dataType.simpleString()
    found = None
    for b in range(blocks):
        # About QUERY_BYTES at most: this part of the items, whatever the number of items.
        part = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").toArrow().combine_chunks()
        coded = part.column("term").combine_chunks().dictionary_encode() if part.num_rows else pa.array([], pa.string()).dictionary_encode()
        terms = spark.sparkContext.broadcast(coded.dictionary.to_pylist())
        forward = settle(texts.mapInArrow(lean(_forward(terms)), f"doc_id {kinds[0]}, n long, terms array<int>, tfs array<long>"))
        whole = forward.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).head()
        df = np.zeros(len(terms.value), np.int64)
        held = forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).toArrow()  # a row per term of the part
        df[held.column(0).to_numpy()] = held.column(1).to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * whole["documents"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        ids = part.column("item_id").combine_chunks() if part.num_rows else pa.array([], part.schema.field("item_id").type)
        run_ends = pc.run_end_encode(ids)
        ends = np.concatenate([[0], run_ends.run_ends.to_numpy()]) if len(ids) else np.zeros(1, np.int64)
        query = spark.sparkContext.broadcast((run_ends.values, ends, coded.indices.to_numpy(), weight))
        id_type = _arrow_type(texts, "doc_id")
        some = forward.where(F.size("terms") > 0).mapInArrow(lean(_search(query, k, whole["documents"], whole["total"], id_type)), f"item_id {kinds[1]}, doc_id {kinds[0]}, score long")
        found = some if found is None else found.union(some)
    found = _ranked(found.withColumn("group", F.spark_partition_id() % shuffle_width(spark)), k, "item_id", "group")
    return _ranked(found.select("item_id", "doc_id", "score"), k, "item_id").select("item_id", "rank", "doc_id", "score")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w)) AS total FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT k, doc_id, term, len(w) AS n, count(*) AS tf FROM (SELECT k, doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs),
r AS (SELECT item_id, k, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, k, doc_id),
t AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM t WHERE rank <= 50"""
