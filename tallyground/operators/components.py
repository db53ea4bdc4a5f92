"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.settings import cut_lineage

# A graph of at most so many edges (two numbers each) is solved in one task; the count is checked before.
ONE_TASK = 1_000_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that are not the smallest of their component, each with the smallest."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(place, 2)
    parent = np.arange(len(nodes))
    while True:
        high, low = np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b])
        apart = high != low
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while not np.array_equal(parent, above := parent[parent]):
            parent = above
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _per_part(batches: Iterator[pa.RecordBatch]):
    """A star per component of the edges of one partition: the same components with fewer edges."""
    parts = [batch for batch in batches if batch.num_rows]
    if parts:
        u, v = (np.concatenate([np.asarray(batch.column(k)) for batch in parts]) for k in (0, 1))
        kind = parts[0].schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in _roots(u, v)], names=["u", "v"])


def _forest(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()
    return edges.mapInArrow(_per_part, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, root`` for every node with an edge that is not the smallest node of its component.

    A graph of at most ``ONE_TASK`` edges is solved in one task. A larger one is first reduced to a forest within ranges of
    nodes, each in its own task. Then each round every node moves to the smallest neighbour of its smallest neighbour, and
    edges that then lie within one node vanish; what is left between the moved nodes shrinks from round to round until one
    task can end it. The smallest neighbour is an aggregate with map-side combine, so a hub costs one row per task; joins
    meet a hub with a one-row side, which AQE splits when the hub is hot. Each round is written to the shared folder.
    """
    edges = cut_lineage(edges.filter("u <> v").select("u", "v"))
    left, labels = edges.count(), None
    if left > ONE_TASK:
        edges = cut_lineage(_forest(edges.repartitionByRange("u")))
        left = edges.count()
    while left > ONE_TASK:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        onward = near.select(F.col("u").alias("p"), F.col("p").alias("root"))
        moved = cut_lineage(near.join(onward, "p").select("u", "root"))
        labels = _after(labels, moved)
        a, b = (moved.select(F.col("u").alias(end), F.col("root").alias(f"{end}_root")) for end in ("u", "v"))
        ends = edges.join(a, "u").join(b, "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).filter("u <> v")
        edges = cut_lineage(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        left = edges.count()
    last = _forest(edges.coalesce(1)).withColumnRenamed("v", "root")
    return _after(labels, cut_lineage(last)).filter("u <> root")


def _after(labels: DataFrame | None, moved: DataFrame) -> DataFrame:
    """The labels of all nodes after the nodes of the smaller graph have moved.

    A label names a node of the smaller graph, which need not have the label of the node it is named after.
    """
    if labels is None:
        return moved
    step = moved.select(F.col("u").alias("root"), F.col("root").alias("next"))
    return labels.join(step, "root", "left").select("u", F.coalesce("next", "root").alias("root"))
