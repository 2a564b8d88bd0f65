"""A detector by itself, from the command line: records of one image or of listed images as JSON lines (SRC3, SRC4, SRC11, UDF7)."""

from __future__ import annotations

import argparse
import importlib
import inspect
import json
import os
import sys
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk import schema, sinks
from kinfolk.functions.codec import encode_each
from kinfolk.operators.extract import extract
from kinfolk.sources.images import one_image, read_listed, read_path_list

USAGE = "an image or --list is needed"


def detector_factory(name: str, gpu: bool, max_dim: int, thumb_dir: str | None = None) -> Callable:
    """The factory ``module:name`` with its settings; one that takes no folder for thumbnails gets none."""
    module, function = name.split(":")
    make = getattr(importlib.import_module(module), function)
    given: dict = {"gpu": gpu, "max_dim": max_dim}
    if thumb_dir is not None and "thumb_dir" in inspect.signature(make).parameters:
        given["thumb_dir"] = thumb_dir
    return partial(make, **given)


def wire_records(extractions: DataFrame) -> DataFrame:
    """Records as they are stored: embeddings as base64 of 32-bit floats, no error without a text."""
    held = extractions.withColumn("texts", encode_each(F.transform("faces", lambda f: f["embedding"])))
    face = lambda f, t: F.struct(f["bbox"].alias("bbox"), t.alias("embedding"), f["det_score"].alias("det_score"), f["thumbnail"].alias("thumbnail"))
    return held.select("file", F.zip_with("faces", "texts", face).alias("faces"), F.when(F.col("error") != "", F.col("error")).alias("error"))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("kinfolk-detect", description="Records of the faces in images.")
    p.add_argument("image", nargs="?", help="a single image; its record goes to standard output")
    p.add_argument("--list", help="file of image paths, one a line, or - for standard input; goes before a single image")
    p.add_argument("--records", help="folder for the records of a list; without it they go to standard output")
    p.add_argument("--detector", required=True, help="module:name of a detector factory")
    p.add_argument("--gpu", action="store_true", help="pass gpu=True to the factory")
    p.add_argument("--thumb-dir", help="folder for thumbnails, passed to a factory that takes it")
    p.add_argument("--max-dim", type=int, default=0, help="longest side that the detector gets, 0 for any")
    p.add_argument("--fail-fast", action="store_true", help="end at the first failure of the detector")
    return p.parse_args(argv)


def _listed(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.list == "-":
        return spark.createDataFrame([(x.strip(),) for x in sys.stdin if x.strip()], schema.IMAGES)
    return read_path_list(spark, a.list) if a.list else one_image(spark, a.image)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if not a.list and not a.image:
        print(json.dumps({"error": USAGE, "faces": []}))
        return 1
    if a.thumb_dir:
        os.makedirs(a.thumb_dir, exist_ok=True)
    spark = SparkSession.builder.appName("kinfolk-detect").getOrCreate()
    found = extract(read_listed(_listed(spark, a)), detector_factory(a.detector, a.gpu, a.max_dim, a.thumb_dir), fail_fast=a.fail_fast)
    records = wire_records(found)
    if a.list and a.records:
        sinks.write_extractions(records, a.records)
        return 0
    for r in records.select(F.to_json(F.struct("*")).alias("value")).toLocalIterator():
        print(r.value)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
