"""Detectors as a table function from images to records (SRC5, MAP8, MAP9, UDF1-UDF7, AGG9).

A detector is any picklable factory that returns ``detect(batch) -> list``: it gets a list of (path, bytes) and
gives for each a list of detections, or an error text. The factory runs once per Python worker, so that a model is
loaded once; images come in Arrow batches and are never split. ``staged`` builds such a factory of the steps of a detector, and
has faces of several images recognised at once. No model is shipped.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk import schema

log = logging.getLogger(__name__)
Detect = Callable[[list], list]
#: Faces that are recognised at once, at least; those of an image stay together.
RECOGNISE_FACES = 32


@dataclass(frozen=True)
class Stages:
    """The steps of a detector, of which only ``recognise`` and ``thumbnail`` may be missing."""

    load: Callable[[str, bytes | None], Any]  # pixels, scaled down if wanted; None if they cannot be read
    detect: Callable[[Any], list[tuple[list[float], float, Any]]]  # box, score and aligned face of each face
    recognise: Callable[[list], np.ndarray] | None  # a vector for each aligned face
    embed: Callable[[Any], Any] | None = None  # the vector of one aligned face, for detectors without ``recognise``
    thumbnail: Callable[[Any, list[float], str, int], str] | None = None  # cuts and stores one, gives its path
    providers: tuple[str, ...] = ()  # what the models run on


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-10)


def _staged(make: Callable[[], Stages], faces: int) -> Detect:
    s = make()
    if s.providers:
        log.info("models run on %s", sorted(set(s.providers)))

    def detect(batch: list) -> list:
        results: list = [None] * len(batch)
        waiting: list[tuple[int, Any, list]] = []

        def flush() -> None:
            aligned = [face for _, _, found in waiting for _, _, face in found]
            if not aligned:
                return
            vectors = _unit(s.recognise(aligned) if s.recognise else np.stack([np.asarray(s.embed(a)) for a in aligned]))
            at = 0
            for k, image, found in waiting:
                results[k] = [
                    {"bbox": [float(x) for x in box], "embedding": vectors[at + i].tolist(), "det_score": float(score),
                     "thumbnail": s.thumbnail(image, box, batch[k][0], i) if s.thumbnail else ""}
                    for i, (box, score, _) in enumerate(found)
                ]
                at += len(found)
            waiting.clear()

        for k, (path, content) in enumerate(batch):
            image = s.load(path, content)
            if image is None:
                results[k] = f"cannot read image: {path}"
                continue
            found = s.detect(image)
            results[k] = []
            if found:
                waiting.append((k, image, found))
            if sum(len(f) for _, _, f in waiting) >= (faces if s.recognise else 1):
                flush()
        flush()
        return results

    return detect


def staged(make: Callable[[], Stages], faces: int = RECOGNISE_FACES) -> Callable[[], Detect]:
    """A factory for ``extract`` of the steps that ``make`` returns in each worker: faces wait until there are ``faces`` of them, then
    all are recognised in one call, their vectors normalised and given back to their images. Without ``recognise`` images go one by one."""
    return partial(_staged, make, faces)


def extract(images: DataFrame, factory: Callable[[], Detect], batch: int = 32, fail_fast: bool = False) -> DataFrame:
    """``file, faces, error`` of ``images(path, content)``. One image's failure is its error and not the run's, unless
    ``fail_fast`` is set: then the first failure of a batch ends the run."""

    def run(batches):
        detect = factory()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                given = list(zip(part.path, part.content))
                try:
                    results = detect(given)
                except Exception:
                    if fail_fast:
                        raise
                    # one bad image must not fail its batch: images are tried one by one
                    results = []
                    for one in given:
                        try:
                            results += detect([one])
                        except Exception as e:
                            results.append(f"extraction error: {e}")
                errors = [r if isinstance(r, str) else None for r in results]
                faces = [[] if isinstance(r, str) else [dict(d) for d in r] for r in results]
                yield pd.DataFrame({"file": list(part.path), "faces": faces, "error": errors})

    return images.select("path", "content").mapInPandas(run, schema.EXTRACTION)


def faces_and_errors(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces (without ``face_id``) and file errors; an image with an error gives no faces (MAP4-MAP6)."""
    failed = F.coalesce("error", F.lit("")) != ""
    faces = extractions.where(~failed).select(F.col("file").alias("file_path"), F.posexplode("faces").alias("face_idx", "f"))
    bbox = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get("f.bbox", i), F.lit(0.0)))
    faces = faces.select(
        "file_path", "face_idx", bbox.alias("bbox"), F.col("f.embedding").alias("embedding"),
        F.coalesce("f.det_score", F.lit(0.0)).alias("det_score"), F.coalesce("f.thumbnail", F.lit("")).alias("thumbnail"),
    )
    return faces, extractions.where(failed).select(F.col("file").alias("path"), "error")
