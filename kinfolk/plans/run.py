"""A whole run: from faces, or from records of a detector, to persons and the report (entry A), and the command line."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk import sinks
from kinfolk.functions.paths import walk_order
from kinfolk.functions.ranking import with_position
from kinfolk.functions.scratch import materialize, scratch_scope
from kinfolk.operators.components import components
from kinfolk.operators.describe import ChatEndpoint, describe
from kinfolk.operators.extract import extract, faces_and_errors
from kinfolk.operators.persons import person_photos, persons
from kinfolk.operators.similarity import similar_pairs, split_by_dimension
from kinfolk.plans.detect import detector_factory
from kinfolk.plans.report import build_report, error_table
from kinfolk.plans.serve import serve
from kinfolk.sources.extractions import read_extractions
from kinfolk.sources.images import one_image, read_images, read_listed, read_path_list, scan_images
from kinfolk.sources.stored import load_settings

log = logging.getLogger(__name__)
THRESHOLD = 0.5


@dataclass(frozen=True)
class Grouping:
    faces: DataFrame
    edges: DataFrame
    components: DataFrame
    persons: DataFrame
    file_errors: DataFrame


def number_faces(faces: DataFrame) -> DataFrame:
    """``face_id`` in the order of a walk over the paths, then of the faces in an image; several records of one file are told
    apart by what else they hold."""
    others = [F.asc(c) for c in ("det_score", "thumbnail", "bbox", "embedding") if c in faces.columns]
    numbered = with_position(faces.withColumn("__order", walk_order(F.col("file_path"))), "face_id", F.asc("__order"), F.asc("face_idx"), *others)
    return numbered.drop("__order")


def group_faces(faces: DataFrame, threshold: float = THRESHOLD, method: str = "blocked") -> Grouping:
    """Faces with ``face_id, file_path, embedding, det_score, thumbnail`` into persons."""
    fit, odd = split_by_dimension(faces)
    edges = materialize(similar_pairs(fit, threshold, method))
    comps = materialize(components(fit, edges))
    return Grouping(fit, edges, comps, persons(fit, comps), odd)


def _write(spark: SparkSession, images: DataFrame, found: DataFrame, errors: DataFrame, output_dir: str, threshold: float, input_dir: str, link: bool, gpu: bool, describer, started: datetime) -> DataFrame | None:
    if images.isEmpty():
        log.warning("no images")
        return None
    faces = materialize(number_faces(found))
    if faces.isEmpty():
        log.warning("no faces")
        return None
    g = group_faces(faces, threshold)
    people = materialize(g.persons)
    errors = materialize(errors.unionByName(g.file_errors))
    sinks.clean_output(output_dir)
    with sinks.run_log(output_dir):
        links = materialize(sinks.manifest(people, person_photos(g.components.join(g.faces, "face_id"))))
        sinks.write_manifest(links, output_dir)
        for failure in sinks.link_photos(links, output_dir) if link else ():
            log.warning("not linked: %s", failure)
        people = materialize(sinks.copy_thumbnails(people, output_dir))
        if describer is not None and not people.where("thumbnail <> ''").isEmpty():
            people = materialize(describe(people, describer, sinks.copied_thumbnails(spark, output_dir)))
        report = build_report(
            images, faces, people, errors, started_at=started, finished_at=datetime.now(UTC), input_dir=input_dir, output_dir=output_dir, threshold=threshold, gpu=gpu
        )
        # the row is all that is returned, and the scratch tables go with the run
        report = spark.createDataFrame(report.collect(), report.schema)
        sinks.save_report(report, people, error_table(errors), output_dir)
        log.info("%s", sinks.summary(report))
    return report


def run_records(
    spark: SparkSession, images: DataFrame, records: str, output_dir: str, threshold: float = THRESHOLD, input_dir: str = "", link: bool = True, describer=None
) -> DataFrame | None:
    """Group the faces of a detector's records and write the results; None, and nothing written, without faces."""
    started = datetime.now(UTC)
    with scratch_scope(spark):
        got = read_extractions(spark, records)
        log.info("%d records of %d images, %d lines skipped", got.processed.count(), images.count(), got.skipped.count())
        return _write(spark, images, got.faces, got.file_errors, output_dir, threshold, input_dir, link, False, describer, started)


def run_images(
    spark: SparkSession, source: str | DataFrame, factory: Callable, output_dir: str, threshold: float = THRESHOLD, link: bool = True, gpu: bool = False, describer=None,
    fail_fast: bool = False,
) -> DataFrame | None:
    """Read the images of a folder, or those listed in ``source(path)``, detect faces with ``factory`` in the executors, group
    them and write the results. With ``fail_fast`` the first failure of a detector ends the run."""
    started = datetime.now(UTC)
    listed = isinstance(source, DataFrame)
    with scratch_scope(spark):
        images = read_listed(source) if listed else read_images(spark, source, content=True).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
        records = materialize(extract(images, factory, fail_fast=fail_fast))
        faces, errors = faces_and_errors(records)
        return _write(spark, records.select(F.col("file").alias("path")), faces, errors, output_dir, threshold, "" if listed else source, link, gpu, describer, started)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("kinfolk", description="Group photos by the people in them. How many work at once is Spark's setting.")
    p.add_argument("--input", help="folder of images")
    p.add_argument("--image", help="a single image, instead of --input")
    p.add_argument("--list", help="file of image paths, one a line, instead of --input")
    p.add_argument("--fail-fast", action="store_true", help="end the run at the first failure of the detector")
    p.add_argument("--records", help="JSON lines of a detector for these images")
    p.add_argument("--detector", help="module:name of a detector factory, instead of records")
    p.add_argument("--gpu", action="store_true", help="pass gpu=True to the factory")
    p.add_argument("--max-dim", type=int, default=1920, help="longest side that the detector gets, 0 for any; passed to the factory")
    p.add_argument("--output", required=True)
    p.add_argument("--threshold", type=float, default=THRESHOLD)
    p.add_argument("--no-links", action="store_true", help="write the manifest only")
    p.add_argument("--describe", help="prompt for descriptions by the service of --config")
    p.add_argument("--config", default="config.json")
    p.add_argument("--serve", action="store_true", help="serve the results afterwards")
    p.add_argument("--view", action="store_true", help="serve the results of an earlier run and do nothing else")
    p.add_argument("--port", type=int, default=8080)
    return p.parse_args(argv)


def _describer(a: argparse.Namespace) -> ChatEndpoint | None:
    settings = load_settings(a.config) if a.describe else None
    return ChatEndpoint(settings.endpoint, settings.model, a.describe, settings.max_tokens) if settings else None


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if a.view:
        serve(a.output, a.port)
        return 0
    if sum(map(bool, (a.input, a.image, a.list))) != 1 or bool(a.records) == bool(a.detector):
        print("one of --input, --image and --list and one of --records and --detector are needed")
        return 2
    spark = SparkSession.builder.appName("kinfolk").getOrCreate()
    listed = one_image(spark, a.image) if a.image else read_path_list(spark, a.list) if a.list else None
    if a.detector:
        factory = detector_factory(a.detector, a.gpu, a.max_dim, sinks.reset_thumbnails(a.output))
        report = run_images(spark, a.input if listed is None else listed, factory, a.output, a.threshold, not a.no_links, a.gpu, _describer(a), a.fail_fast)
    else:
        images = scan_images(spark, a.input) if listed is None else listed
        report = run_records(spark, images, a.records, a.output, a.threshold, a.input or "", not a.no_links, _describer(a))
    if report is None:
        return 1
    print(sinks.summary(report))
    if a.serve:
        serve(a.output, a.port)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
