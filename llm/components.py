"""Connected components of a graph in DataFrames: alternating large-star and small-star steps (union-find without
a shared structure). Every step halves the depth at least, is written before it is read, and moves only ids.

Before each round every task replaces its own edges by stars, one per component of these edges, in bounded windows. Tasks
take at most some ``TASK_EDGES`` edges, so a small graph needs no round at all and a large one fewer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import roomy, stored

TASK_EDGES = 1 << 18


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that smallest one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    low = label < np.arange(len(nodes))
    return nodes[low], nodes[label[low]]


def contracted(edges: DataFrame) -> DataFrame:
    """u, v (both long) with the same components; of a table that was written."""

    def work(batches):
        u, v, size = [], [], 0
        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            size += len(batch)
            if size >= TASK_EDGES:
                x, y = local_stars(np.concatenate(u), np.concatenate(v))
                if len(x) > TASK_EDGES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
                    x, y = x[:0], y[:0]
                u, v, size = [x], [y], len(x)
        if size:
            x, y = local_stars(np.concatenate(u), np.concatenate(v))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])

    return edges.coalesce(-(-edges.count() // TASK_EDGES) or 1).mapInArrow(roomy(work), "u long, v long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node."""
    now = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")))
    for _ in range(most_rounds):
        now = stored(contracted(now))
        ends = stored(lower_ends(now))
        # in stars every node has one smaller neighbour at most, and that one has none
        if ends.filter((F.col("lo") < F.col("hi")) | (F.col("lo").isNotNull() & F.col("over"))).isEmpty():
            return ends.select("node", F.coalesce("lo", "node").alias("component"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u != v").distinct())
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        now = stored(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
    raise RuntimeError("the components did not settle")


def lower_ends(edges: DataFrame) -> DataFrame:
    """node, its smallest and largest smaller neighbour, whether it is a smaller neighbour itself. ``edges``: u > v."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("low"), F.lit(False).alias("over"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("low"), F.lit(True).alias("over")))
    return ends.groupBy("node").agg(F.min("low").alias("lo"), F.max("low").alias("hi"), F.max("over").alias("over"))
