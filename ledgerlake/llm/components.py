"""Connected components of a table of links, by joins; nothing is collected.

A partition of at most ``EDGES`` links contracts them alone to stars (each node
to its smallest).  If one partition holds all links that is the answer.  Else
large-star and small-star rounds (Kiveris et al., 2014) follow until nothing
changes; each is a minimum per node and a join, its result settled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle
from .workers import lean

EDGES = 250_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links and the smallest node it reaches."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if table:
        u, v = smallest_reachable(np.concatenate([a for a, _ in table]), np.concatenate([b for _, b in table]))
        yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])


def components(links: DataFrame, many: int) -> DataFrame:
    """node, component for all nodes of ``links`` (a, b) but the components' smallest;
    ``many`` is the number of links."""
    parts = -(-many // EDGES) or 1
    stars = links.select(F.col("a").alias("u"), F.col("b").alias("v")).repartition(parts).mapInArrow(lean(_contract), "u long, v long")
    if parts > 1:
        stars = settle(stars)
        last = None
        while True:
            both = stars.union(stars.select("v", "u"))
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
            stars = settle(small)
            now = stars.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).head()
            if now == last:
                break
            last = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
