"""Results on disk (SNK1-SNK8). Originals are linked or copied from, never written to."""

from __future__ import annotations

import json
import logging
import os
import re
import shutil
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.functions.paths import basename

log = logging.getLogger("kinfolk")
LOG_FILE = "processing.log"
REPORT_FILE = "report.json"
THUMBNAIL_FILE = "thumb.jpg"
THUMBNAIL_FOLDER = ".thumbnails"


def clean_output(folder: str) -> None:
    """Remove the ``Person_N`` folders and the report of an earlier run; all else stays."""
    os.makedirs(folder, exist_ok=True)
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        if re.fullmatch(r"Person_\d+", name) and os.path.isdir(path) and not os.path.islink(path):
            shutil.rmtree(path)
        elif name == REPORT_FILE:
            os.remove(path)


@contextmanager
def run_log(folder: str):
    """What is logged meanwhile also goes to a file of the run, which starts anew."""
    to = logging.FileHandler(os.path.join(folder, LOG_FILE), mode="w")
    level = log.level
    log.addHandler(to)
    log.setLevel(logging.INFO)
    try:
        yield
    finally:
        log.setLevel(level)
        log.removeHandler(to)
        to.close()


def link_name(path: Column, clashes: Column) -> Column:
    """Name of a photo in its person's folder; one that clashes, or is kept for the thumbnail, gets a hash of its path."""
    name = basename(path)
    short = F.substring(F.sha2(path, 256), 1, 12)
    return F.when(clashes | (F.lower(name) == THUMBNAIL_FILE), F.concat(short, F.lit("_"), name)).otherwise(name)


def manifest(persons: DataFrame, person_photos: DataFrame) -> DataFrame:
    """``person_id, photo_path, link_name``: which photo is linked where; names are unique within a person."""
    p = persons.select("id", "component_id").join(person_photos, "component_id")
    names = p.groupBy("id", F.lower(basename(F.col("file_path"))).alias("name")).agg(F.count("*").alias("n"))
    p = p.withColumn("name", F.lower(basename(F.col("file_path")))).join(names, ["id", "name"])
    return p.select(F.col("id").alias("person_id"), F.col("file_path").alias("photo_path"), link_name(F.col("file_path"), F.col("n") > 1).alias("link_name"))


def write_manifest(links: DataFrame, folder: str) -> None:
    links.write.mode("overwrite").parquet(os.path.join(folder, "manifest"))


def link_photos(links: DataFrame, folder: str) -> list[str]:
    """Make the folders and links on the driver's file system, streaming rows; what failed is returned.

    A link that cannot be made becomes a copy; an existing name is never written through.
    """
    failed = []
    for r in links.toLocalIterator():
        target = os.path.join(folder, f"Person_{r.person_id}")
        os.makedirs(target, exist_ok=True)
        path = os.path.join(target, r.link_name)
        if os.path.lexists(path):
            failed.append(f"{path}: exists")
            continue
        try:
            os.symlink(os.path.abspath(r.photo_path), path)
        except OSError:
            try:
                shutil.copyfile(r.photo_path, path)
            except OSError as e:
                failed.append(f"{r.photo_path}: {e}")
    return failed


def reset_thumbnails(folder: str) -> str:
    """An empty folder for the thumbnails of a run; those of an earlier run go."""
    path = os.path.join(folder, THUMBNAIL_FOLDER)
    shutil.rmtree(path, ignore_errors=True)
    os.makedirs(path)
    return path


def copy_thumbnail(thumbnail: str, folder: str, person_id: int) -> str:
    """Copy a thumbnail beside its person's photos; its reference, or an empty text if that fails."""
    target = os.path.join(folder, f"Person_{person_id}")
    try:
        os.makedirs(target, exist_ok=True)
        shutil.copyfile(thumbnail, os.path.join(target, THUMBNAIL_FILE))
    except OSError as e:
        log.warning("person %s: no thumbnail: %s", person_id, e)
        return ""
    return f"Person_{person_id}/{THUMBNAIL_FILE}"


def copy_thumbnails(persons: DataFrame, folder: str) -> DataFrame:
    """Copy every person's thumbnail, streaming rows; ``persons`` with references to the copies, empty where that failed."""
    some = persons.where("thumbnail <> ''").select("id", "thumbnail")
    failed = [(r.id,) for r in some.toLocalIterator() if not copy_thumbnail(r.thumbnail, folder, r.id)]
    lost = persons.sparkSession.createDataFrame(failed, "id bigint").withColumn("lost", F.lit(True))
    reference = F.concat(F.lit("Person_"), F.col("id").cast("string"), F.lit("/" + THUMBNAIL_FILE))
    own = F.when((F.col("thumbnail") == "") | F.col("lost").isNotNull(), F.lit("")).otherwise(reference)
    return persons.join(lost, "id", "left").withColumn("thumbnail", own).drop("lost").select(*persons.columns)


def copied_thumbnails(spark: SparkSession, folder: str) -> DataFrame:
    """``thumbnail, content`` of the copies, listed and read by Spark."""
    files = spark.read.format("binaryFile").load(os.path.join(folder, "Person_*", THUMBNAIL_FILE))
    return files.select(F.regexp_extract("path", r"(Person_\d+/[^/]*)$", 1).alias("thumbnail"), "content")


def _plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
        return {k: _plain(x) for k, x in v.items() if k != "description" or x}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v.isoformat() if isinstance(v, datetime) else v


def _indented(value, by: int) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * by)


PERSON_FIELDS = ("id", "photo_count", "face_count", "thumbnail", "description", "photos")
REPORT_FIELDS = ("started_at", "finished_at", "duration", "input_dir", "output_dir", "total_images", "total_faces", "total_persons", "errors")


def save_report(report: DataFrame, persons: DataFrame, errors: DataFrame, folder: str) -> str:
    """Write one indented JSON document row by row: no more than a partition of persons or errors is on the driver.

    ``errors`` has one row a path. An empty error table and empty descriptions are left out.
    """
    row = _plain(report.first())
    path = os.path.join(folder, REPORT_FILE)
    listed = [c for c in PERSON_FIELDS if c in persons.columns]
    parts = [(f'"{c}": ' + _indented(row[c], 2)) for c in REPORT_FIELDS]
    with open(path, "w") as f:
        f.write("{\n  " + ",\n  ".join(parts))
        between = ',\n  "file_errors": {\n    '
        for r in errors.orderBy("path").toLocalIterator():
            f.write(f"{between}{json.dumps(r.path, ensure_ascii=False)}: {json.dumps(r.error, ensure_ascii=False)}")
            between = ",\n    "
        f.write("\n  }" if not between.startswith(',\n  "') else "")
        f.write(f',\n  "threshold": {json.dumps(row["threshold"])},\n  "gpu": {json.dumps(row["gpu"])},\n  "persons": [')
        between = "\n    "
        for r in persons.select(*listed).orderBy("id").toLocalIterator():
            f.write(between + _indented(_plain(r), 4))
            between = ",\n    "
        f.write("]\n}\n" if between == "\n    " else "\n  ]\n}\n")
    return path


def write_extractions(extractions: DataFrame, path: str) -> None:
    """Extraction records as JSON lines."""
    extractions.write.mode("overwrite").json(path)


def summary(report: DataFrame) -> str:
    r = report.select("total_images", "total_faces", "total_persons", "errors", "duration").first()
    return f"images {r.total_images}, faces {r.total_faces}, persons {r.total_persons}, errors {r.errors}, time {r.duration}"
