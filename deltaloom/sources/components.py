"""Connected components of an undirected graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.sources.shared import remove, table


def star_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component, for edges a-b held in memory."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


EDGES = 1_000_000


def _contract(batches):
    """Replaces each million edges of a partition by stars with the same components."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nodes, low = star_labels(*(np.concatenate(c) for c in zip(*held)))
        keep = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
        if size >= EDGES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def connected_components(spark: SparkSession, edges: DataFrame, at_once: int = 0) -> DataFrame:
    """(node, root) for every node of the edges (u, v: long, both sides not null); root is the component's least node.

    Partition-local contraction, then alternating large and small stars until the set of edges is a fixed
    point (logarithmically many rounds). A hub's rows meet in partial aggregates, and in joins of two written tables:
    both sides come straight from an exchange, so adaptive execution can cut a hub's partition into parts, which it
    can't where an aggregate stands between. Self-loops are ignored; an empty input gives an empty result.
    Up to at_once contracted edges (a million at most) are settled by one task instead.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    edges, path = table(edges.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    stamp = None
    if at_once and edges.count() <= min(at_once, EDGES):
        edges = table(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), "edges")[0]
        stars = edges.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("root"))
        remove(spark, path)
        return stars.distinct()
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == stamp:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        stamp = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large, large_path = table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        lower, lower_path = table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lower.select("u", F.col("m").alias("v")))
        edges, next_path = table(small.where("u <> v").distinct(), "edges")
        for done in (path, least_path, large_path, lower_path):
            remove(spark, done)
        path = next_path
