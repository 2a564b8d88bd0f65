"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios (operator 2).

Features are the n-grams of 3 to 5 characters of the lower-cased text, hashed, present or not. From the
training rows come their document counts by class and, from these, log-count ratios; the ratios scale
the features of a logistic regression, which is the model. Labels come only from rows with ``crc32(doc_id) % 3 <> 1``; language,
source and ids are no features. Scoring reads every whole text in its scan, with no exchange.

Parameters of the model, the same at every size of input: it is fitted once, in one task, on labelled rows in order of a
hash of their id, at most ``SAMPLE_ROWS`` documents and, after the first, ``SAMPLE_BYTES`` of text; of the hashed n-grams in ``MIN_DOCUMENTS`` of these
or more it keeps the ``MAX_FEATURES`` whose counts by class surprise most. Scores are calibrated: ``FOLDS`` models that each leave out a part of
the sample score that part, and a slope and a shift that make these scores shares of toxic rows are applied to the model of all rows.

Cases: a null or empty text scores by the model's bias alone; very long texts are scored whole; without labelled rows of both classes
the score is the share of toxic training rows (0 if there are none); repeated rows are scored each, and of several texts
of one id the smallest is learned from; a document with several labels is toxic if one says so; null labels are left out;
an empty table gives no rows; extra columns, whatever their names, stay in ``without_toxic`` and never take part; ``score`` replaces a column of its result's name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfolk.llm.common import give_back, stretches, table

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 8000
#: Bytes of their texts, at most, but for the first.
SAMPLE_BYTES = 128 << 20
SIZES = (3, 4, 5)
HASH_BITS = 20
MAX_FEATURES = 2000
MIN_DOCUMENTS = 4
SMOOTHING = 0.5
PENALTY = 2e-4
STEPS = 300
#: Models that each leave out a part of the sample, on whose scores of that part the final one is calibrated.
FOLDS = 3
CUT = 0.7
BLOCK_BYTES = 4 << 20

_U = np.uint64


@dataclass(frozen=True)
class Model:
    slots: np.ndarray  # hashes of the features, ascending
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        t = np.zeros(1 << HASH_BITS, np.int16)
        t[self.slots] = np.arange(1, len(self.slots) + 1)
        return t


def _blocks(texts: list[str], most: int = 1 << 20):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= most):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def _grams(texts: list[str]):
    """For each n-gram size: hash slots by position, and the function that gives positions their text (-1: across two)."""
    low = [t.lower() for t in texts]
    offs = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=offs[1:])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = code + _U(1)
    for n in range(2, max(SIZES) + 1):
        if len(code) < n:
            return
        h = h[:-1] * _U(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in SIZES:
            slot = ((h * _U(0xD6E8FEB86659FD93) + _U(n)) >> _U(64 - HASH_BITS)).astype(np.int32)

            def owner(at: np.ndarray, n=n) -> np.ndarray:
                d = np.searchsorted(offs, at, "right") - 1
                return np.where(offs[d + 1] >= at + n, d, -1)

            yield slot, owner


def present(texts: list[str], lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature) of the features present; without ``lookup`` features are hash slots."""
    docs, feats = [], []
    for i, j in _blocks(texts):
        keys = []
        for slot, owner in _grams(texts[i:j]):
            if lookup is None:
                at, f = np.arange(len(slot)), slot.astype(np.int64)
            else:
                f = lookup[slot]
                at = np.flatnonzero(f)
                f = f[at].astype(np.int64) - 1
            d = owner(at)
            keys.append(np.unique((d[d >= 0] << HASH_BITS) | f[d >= 0]))
        if keys:
            k = np.unique(np.concatenate(keys))
            docs.append((k >> HASH_BITS) + i)
            feats.append(k & ((1 << HASH_BITS) - 1))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(feats)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _constant(share: float) -> Model:
    p = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))


def _counts(texts: list[str], y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Documents by fold, class (0: toxic) and hash slot."""
    n = np.zeros((int(fold.max(initial=0)) + 1, 2, 1 << HASH_BITS), np.int32)
    for i, j in _blocks(texts):
        d, f = present(texts[i:j])
        kind = 2 * fold[i:j][d] + (y[i:j][d] <= 0)
        for k in np.unique(kind):
            n[k // 2, k % 2] += np.bincount(f[kind == k], minlength=1 << HASH_BITS).astype(np.int32)
    return n


def _features(pos: np.ndarray, neg: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash slots whose counts by class surprise most, ascending, and their log-count ratios."""
    share, n_pos, n_neg = float(y.mean()), y.sum(), (1 - y).sum()
    ratio = np.log((pos + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    expected = (pos + neg) * share
    surprise = np.where(pos + neg >= MIN_DOCUMENTS, (pos - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), 0)
    slots = np.sort(np.argsort(-surprise, kind="stable")[:MAX_FEATURES])
    slots = slots[surprise[slots] > 0]
    return slots, ratio[slots]


def _regress(docs: np.ndarray, feats: np.ndarray, slots: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> Model:
    """Accelerated gradient steps on the log loss with a squared penalty; pairs (text, feature) are in order of texts."""
    share = float(y.mean())
    value = ratio[feats]
    w, b = np.zeros(len(slots)), float(np.log(share / (1 - share)))
    v, vb = w.copy(), b
    norms = np.bincount(docs, value**2, minlength=len(y))
    rate = 4.0 / (np.percentile(norms, 99) + 1)
    for k in range(STEPS):
        z = np.bincount(docs, value * v[feats], minlength=len(y)) + vb
        g = _sigmoid(z) - y
        grad = np.bincount(feats, value * g[docs], minlength=len(slots)) / len(y) + PENALTY * v
        scale = rate * min(len(y), 40)
        nw, nb = v - scale * grad, vb - min(scale, 1.0) * float(g.mean())
        m = k / (k + 3)
        v, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return Model(slots, w * ratio, b)


def _fits(texts: list[str], y: np.ndarray, fold: np.ndarray, left_out: list[int]) -> tuple[list[Model], np.ndarray]:
    """A model of the rows outside each fold of ``left_out`` (-1: of all rows), and the log-odds that each gives to every row."""
    by_fold = _counts(texts, y, fold)
    total = by_fold.sum(axis=0)
    own = [total - by_fold[k] if k >= 0 else total for k in left_out]
    rows = [fold != k for k in left_out]
    both = [0 < y[r].sum() < r.sum() for r in rows]
    chosen = [_features(*n.astype(float), y[r]) if ok else (np.zeros(0, np.int64), np.zeros(0)) for n, r, ok in zip(own, rows, both)]
    every = np.unique(np.concatenate([s for s, _ in chosen]))
    docs, feats = present(texts, Model(every, np.zeros(0), 0.0).table())
    models, odds = [], []
    for (slots, ratio), r, ok in zip(chosen, rows, both):
        if not ok:
            models.append(_constant(float(y[r].mean()) if r.any() else 0.0))
            odds.append(np.full(len(y), models[-1].bias))
            continue
        at = np.full(len(every) + 1, -1, np.int64)
        at[np.searchsorted(every, slots)] = np.arange(len(slots))
        d, f = docs[at[feats] >= 0], at[feats][at[feats] >= 0]
        inside = r[d]
        m = _regress((np.cumsum(r) - 1)[d[inside]], f[inside], slots, ratio, y[r])
        models.append(m)
        odds.append(np.bincount(d, m.weights[f], minlength=len(y)) + m.bias)
    return models, np.array(odds)


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """The regression on all rows, as it is."""
    y = np.asarray(labels, float)
    return _fits(texts, y, np.zeros(len(y), np.int64), [-1])[0][0] if len(y) else _constant(0.0)


def calibration(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of log-odds, so that the logistic function of them is the share of toxic rows.

    Newton steps on the log loss; the classes' targets are kept from 0 and 1 by one row each, so that both stay finite.
    """
    n_pos, n_neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    x = np.stack([np.clip(odds, -40, 40), np.ones(len(y))], axis=1)

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((np.logaddexp(0, z) - target * z).sum())

    c = np.array([1.0, 0.0])
    for _ in range(100):
        p = _sigmoid(x @ c)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - target))
        far = 1.0
        while far > 1e-6 and loss(c - far * step) > loss(c):
            far /= 2
        c = c - far * step
        if np.abs(far * step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def fit_calibrated(texts: list[str], labels: np.ndarray) -> Model:
    """The regression on all rows, its log-odds calibrated on rows that ``FOLDS`` models of the other rows have not seen.

    A regression nearly separates the rows it is fitted on and is too timid about rare forms elsewhere; log-odds of
    unseen rows tell how far. A slope that is not above 0 would turn the order of scores and leaves the model as it is.
    """
    y = np.asarray(labels, float)
    if not 0 < y.sum() < len(y):
        return fit(texts, y)
    fold = np.arange(len(y)) % FOLDS
    models, odds = _fits(texts, y, fold, [-1, *range(FOLDS)])
    slope, shift = calibration(odds[1 + fold, np.arange(len(y))], y)
    m = models[0]
    return Model(m.slots, m.weights * slope, m.bias * slope + shift) if slope > 0 else m


def score_texts(model: Model, texts: list[str], lookup: np.ndarray | None = None) -> np.ndarray:
    docs, feats = present(texts, model.table() if lookup is None else lookup)
    z = np.bincount(docs, model.weights[feats], minlength=len(texts)) if len(docs) else np.zeros(len(texts))
    return _sigmoid(z + model.bias)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out third; one task reads that sample."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "toxic")

    def fitted(it):
        texts, y, left = [], [], SAMPLE_BYTES
        for pdf in it:
            for t, label in zip(pdf["text"], pdf["toxic"]):
                left -= len(t.encode("utf-8", "surrogatepass"))
                if left >= 0 or not texts:
                    texts.append(t)
                    y.append(label)
        m = fit_calibrated(texts, np.array(y, float))
        import pandas as pd

        del texts
        give_back()
        yield pd.DataFrame({"slots": [m.slots.astype("<i8").tobytes()], "weights": [m.weights.astype("<f8").tobytes()], "bias": [m.bias]})

    r = sample.mapInPandas(fitted, "slots binary, weights binary, bias double").first()
    if r is None:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(r["slots"], "<i8"), np.frombuffer(r["weights"], "<f8"), r["bias"])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with their score in column ``name``; an earlier column of that name is replaced."""
    d = docs.drop(name)
    schema = T.StructType([*d.schema.fields, T.StructField(name, T.DoubleType())])
    at = d.columns.index(text_col)

    def scored(batches):
        lookup = model.table()
        for b in batches:
            s = [score_texts(model, part.to_pylist(), lookup) for _, part in stretches(b.column(at), BLOCK_BYTES)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *s]), pa.float64())], names=[*b.schema.names, name])
        give_back()

    return d.mapInArrow(scored, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    s = score(docs, model)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score below ``cut``, with their columns as they are."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    scored = score(docs, train(docs, labels), name=name)
    return scored.where(F.col(name) < cut).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict = {}
