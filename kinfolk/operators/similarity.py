"""All pairs with cosine similarity at a threshold or above (JOIN1; rules S1-S4, Q1).

The join is exact, so its work is n * n / 2 inner products whatever the plan. ``blocked`` deals vectors to
blocks by a hash and multiplies each pair of blocks once, as matrices in double precision. A vector is sent to
each block pair of its block, so blocks are as large as a task can well hold (some ``BLOCK`` rows), and smaller only where
that leaves too few block pairs to occupy all cores. ``expr`` is the same join in expressions, a nested loop: it is
there for tests of the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.vectors import as_double, dot, normalise

BLOCK = 8192
#: Rows of a block below which splitting it further costs more than it spreads.
SMALL_BLOCK = 512
STRIP = 256


def common_dimension(faces: DataFrame) -> int:
    """Length of the embedding of the first face; 0 if there is none."""
    first = faces.agg(F.min_by(F.size("embedding"), "face_id")).first()[0]
    return max(first or 0, 0)


def split_by_dimension(faces: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Faces of the common dimension, and file errors for those of another."""
    dim = common_dimension(faces) if dim is None else dim
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    text = F.concat(F.lit(f"embedding dimension is not {dim}: "), F.coalesce(F.size("embedding"), F.lit(0)).cast("string"))
    return faces.where(fits), faces.where(~fits).select(F.col("file_path").alias("path"), text.alias("error"))


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in v])
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def _multiply(pdf: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs of one cell, a frame for each strip of its left block: whatever the threshold, no more than a strip is held."""
    i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
    left = pdf[pdf.block == i]
    right = left if i == j else pdf[pdf.block == j]
    if not len(left) or not len(right):
        return
    u = _unit(left.embedding)
    v = u if i == j else _unit(right.embedding)
    a, b = left.face_id.values, right.face_id.values
    for k in range(0, len(a), STRIP):
        sims = u[k : k + STRIP] @ v.T
        hit = sims >= threshold  # false for NaN
        own = a[k : k + STRIP]
        if i == j:
            hit &= own[:, None] < b[None, :]
        r, c = np.nonzero(hit)
        if len(r):
            yield pd.DataFrame({"src": np.minimum(own[r], b[c]), "dst": np.maximum(own[r], b[c]), "sim": sims[r, c]})


def _cells(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs of all cells, from batches in which the rows of a cell stand together."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[["i", "j"]].to_numpy()
        edges = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
        for x, y in zip(edges[:-1], edges[1:]):
            yield from _multiply(pdf.iloc[x:y], threshold)
        rest = pdf.iloc[edges[-1] :]
    if rest is not None:
        yield from _multiply(rest, threshold)


def block_count(rows: int, cores: int, block: int = BLOCK) -> int:
    """Enough blocks that none passes ``block`` rows and, if rows allow, that block pairs are twice the cores."""
    wanted = math.ceil(math.sqrt(4 * cores))
    return max(1, math.ceil(rows / block), min(wanted, math.ceil(rows / min(SMALL_BLOCK, block))))


def similar_pairs(faces: DataFrame, threshold: float, method: str = "blocked", block: int = BLOCK) -> DataFrame:
    """``src < dst, sim`` of the faces (``face_id``, ``embedding``) whose similarity is ``threshold`` or more."""
    f = faces.select("face_id", as_double(F.col("embedding")).alias("embedding"))
    if method == "expr":
        u = f.select("face_id", normalise(F.col("embedding")).alias("u"))
        a, b = u.alias("a"), u.alias("b")
        pairs = a.join(b, F.col("a.face_id") < F.col("b.face_id"))
        pairs = pairs.select(F.col("a.face_id").alias("src"), F.col("b.face_id").alias("dst"), dot(F.col("a.u"), F.col("b.u")).alias("sim"))
        return pairs.where((F.col("sim") >= threshold) & ~F.isnan("sim"))
    blocks = block_count(f.count(), faces.sparkSession.sparkContext.defaultParallelism, block)
    dealt = f.withColumn("block", F.pmod(F.xxhash64("face_id"), F.lit(blocks)).cast("int"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda q: F.struct(F.least("block", q).alias("i"), F.greatest("block", q).alias("j")))
    dealt = dealt.withColumn("p", F.explode(grid)).select("face_id", "embedding", "block", "p.i", "p.j")
    cells = dealt.repartition("i", "j").sortWithinPartitions("i", "j")
    return cells.mapInPandas(lambda it: _cells(it, threshold), "src bigint, dst bigint, sim double")
