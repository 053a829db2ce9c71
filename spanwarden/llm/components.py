"""Connected components: of few edges in one task, of more by large-star and small-star steps in turn (Kiveris et al., 2014).

Up to ``TASK_EDGES`` different edges go to one task, which hooks roots to smaller ones and shortens
paths until no edge lies between two. The stars would take a dozen small queries for as many, whose
plans, threads and broadcasts the driver holds. Beyond that edges stay in DataFrames. A step takes each
node's smallest neighbour with a partially aggregated minimum and joins it back: broadcast while the
nodes are few, else dealt by node and salt, so a hot node's edges are spread either way. Each round is
written to the shared checkpoint folder; rounds go on until an edge set stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.common import cut, cut_counted, join_small

#: Edges (16 bytes each) that one task puts together at most.
TASK_EDGES = 500_000
#: Nodes (16 bytes each) whose smallest neighbours are broadcast at most.
BROADCAST_NODES = 100_000


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # an edge has two nodes at most
    joined = join_small(both, least, ["u"], 2 * n, "inner", BROADCAST_NODES)
    return joined.filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_small(edges, least, ["u"], n, "inner", BROADCAST_NODES).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _together(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) from all edges (u, v), which are in one partition."""
    parts = [np.stack([np.asarray(batch.column(c)) for c in "uv"]) for batch in it]
    if not parts:
        return
    ends = np.concatenate(parts, axis=1)
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = at.reshape(ends.shape)
    top = np.arange(len(nodes))
    while len(u):
        np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))
        while (top != (above := top[top])).any():
            top = above
        u, v = top[u], top[v]
        u, v = u[u != v], v[u != v]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], names=["node", "component"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node; a component is named by its smallest node."""
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, n = cut_counted(edges)
    if n <= TASK_EDGES:
        return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_together, "node long, component long")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    now, was = mark(edges), None
    while now[0] and now != was:
        large = cut(_large(edges, now[0]).distinct())
        edges = cut(_small(large, now[0]).distinct())
        now, was = mark(edges), now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
