"""Connected components over an edge table (IDs GR1-GR5).

The distributed form alternates *large-star* and *small-star* steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014): every step is a partial minimum by node and an
equi-join, so no task ever holds a whole component, and O(log^2 n) steps suffice. Each step is
written to the shared scratch folder, which bounds the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.scratch import materialize

MAX_STEPS = 60
#: Edges that one task may contract at the end: two arrays of 16 MB.
ONE_TASK_EDGES = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. ``edges`` hold u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def star_labels(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` of every node that has an edge to another node; ``edges(src, dst)``.

    ``component_id`` is the smallest id of the component. Loops and repeated edges are ignored; null
    ends are dropped; an empty edge table gives an empty result.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialize(e)
    before = _mark(e)
    for _ in range(MAX_STEPS):
        e = materialize(_small_star(_large_star(e).where("u <> v").distinct()).distinct())
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    roots = e.select(F.col("v").alias("u")).distinct().withColumn("v", F.col("u"))
    return e.unionByName(roots).select(F.col("u").alias("id"), F.col("v").alias("component_id"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of each one's component: labels sink and jump until still."""
    node, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(node))
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if (label == before).all():
            return node, node[label]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    node, label = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for pdf in batches:
        node, label = _forest(np.concatenate([node, pdf.u.values]), np.concatenate([label, pdf.v.values]))
    if len(node):
        yield pd.DataFrame({"u": node, "v": label})


def contracted_labels(edges: DataFrame) -> DataFrame:
    """As ``star_labels``, for few edges: partitions contract theirs to forests, one task contracts these."""
    e = edges.where("src <> dst").select(F.col("src").cast("bigint").alias("u"), F.col("dst").cast("bigint").alias("v"))
    schema = "u bigint, v bigint"
    out = e.mapInPandas(_contract, schema).repartition(1).mapInPandas(_contract, schema)  # coalesce would make one task of both
    return out.select(F.col("u").alias("id"), F.col("v").alias("component_id"))


def component_labels(edges: DataFrame) -> DataFrame:
    """Labels of all nodes with edges. Up to ``ONE_TASK_EDGES`` edges, which are counted, one task ends the
    contraction; beyond, star steps over tables do it all. Both give the same labels."""
    edges = materialize(edges.where("src is not null and dst is not null").select("src", "dst"))
    return contracted_labels(edges) if edges.count() <= ONE_TASK_EDGES else star_labels(edges)


def components(vertices: DataFrame, edges: DataFrame, id_col: str = "face_id") -> DataFrame:
    """Every vertex with the smallest id of its component; a vertex without edges is its own component."""
    labels = component_labels(edges).withColumnRenamed("id", id_col)
    return (
        vertices.select(id_col)
        .join(labels, id_col, "left")
        .select(id_col, F.coalesce("component_id", id_col).alias("component_id"))
    )
