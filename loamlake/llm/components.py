"""Distributed connected components by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.llm.common import cut, forget

#: So many edges (16 bytes each) one task may finish; larger graphs are contracted until they are that small.
LOCAL_EDGES = 1_000_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of the component of each, by hooking roots to smaller ones and halving paths."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(u, r) of a small edge table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            u, r = local_components(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(r, pa.int64())], names=["u", "r"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "u long, r long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node that an edge between two different nodes touches.

    component is the smallest node reachable. In each round every node adopts the node of its closed
    neighbourhood that a fresh hash ranks first, edges are rewritten to the adopted nodes and loops go;
    the expected number of nodes falls by a constant factor each round whatever the shape of the graph,
    so long chains and huge stars both end in O(log n) rounds. Minima combine before the shuffle and the
    per-round maps shrink geometrically; only row counts reach the driver. Once no more than local_edges
    edges are left, of long nodes, one task finishes them; 0 keeps to DataFrame operations throughout.

    Nulls on either side and loops are dropped; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = cut(e)
    most = local_edges if e.schema["u"].dataType.simpleString() == "bigint" else 0
    if 0 < (left := links.count()) <= most:
        return _in_one_task(links).select(F.col("u").alias("node"), F.col("r").alias("component"))
    maps: list[DataFrame] = []
    if left:
        before, links = links, cut(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        forget(before)
    while left:
        seed = F.lit(len(maps) * 7919 + 17)
        best = F.min(F.struct(F.xxhash64("v", seed).alias("h"), F.col("v").alias("x"))).alias("best")
        own = F.struct(F.xxhash64("u", seed).alias("h"), F.col("u").alias("x"))
        adopted = cut(links.groupBy("u").agg(best).select("u", F.least(F.col("best"), own)["x"].alias("r")))
        maps.append(adopted)
        part = links.join(adopted, "u").select(F.col("r").alias("u"), "v")
        other = adopted.select(F.col("u").alias("v"), F.col("r").alias("w"))
        before, links = links, cut(part.join(other, "v").where("u <> w").select("u", F.col("w").alias("v")).distinct())
        forget(before)
        left = links.count()
        if 0 < left <= most:
            maps.append(cut(_in_one_task(links)))
            break
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    root = maps.pop()
    while maps:
        later = root.select(F.col("u").alias("r"), F.col("r").alias("r2"))
        root = maps.pop().join(later, "r", "left").select("u", F.coalesce("r2", "r").alias("r"))
    root = cut(root)
    return root.join(root.groupBy("r").agg(F.min("u").alias("component")), "r").select(F.col("u").alias("node"), "component")
