"""The run report and the questions put to it (AGG6, AGG7, D11, Q-UI1 to Q-UI4)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.duration import duration_text
from kinfolk.functions.ranking import with_position


def error_table(errors: DataFrame) -> DataFrame:
    """``path, error``: one row a path; of several texts the largest stays."""
    return errors.groupBy("path").agg(F.max("error").alias("error"))


def totals(images: DataFrame, faces: DataFrame, persons: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of counts; ``total_images`` counts scanned files, failed ones too."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    joined = one(images, "total_images").crossJoin(one(faces, "total_faces"))
    return joined.crossJoin(one(persons, "total_persons")).crossJoin(one(errors, "errors"))


def build_report(
    images: DataFrame, faces: DataFrame, persons: DataFrame, errors: DataFrame, *,
    started_at: datetime, finished_at: datetime, input_dir: str, output_dir: str, threshold: float, gpu: bool = False,
) -> DataFrame:
    """The report's one row of counts and settings; persons and errors are tables beside it, of any size."""
    return totals(images, faces, persons, errors).select(
        F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(finished_at).cast("timestamp").alias("finished_at"),
        F.lit(duration_text(finished_at - started_at)).alias("duration"),
        F.lit(input_dir).alias("input_dir"), F.lit(output_dir).alias("output_dir"),
        "total_images", "total_faces", "total_persons", "errors", F.lit(float(threshold)).alias("threshold"), F.lit(gpu).alias("gpu"),
    )


def saved_persons(report: DataFrame) -> DataFrame:
    """The persons of a saved report as a table."""
    return report.select(F.explode("persons").alias("p")).select("p.*")


def saved_errors(report: DataFrame) -> DataFrame:
    """The file errors of a saved report as a table."""
    return report.select(F.explode("file_errors").alias("path", "error"))


def stats(report: DataFrame) -> DataFrame:
    mode = F.when(F.col("gpu"), "GPU").otherwise("CPU")
    return report.select("total_images", "total_faces", "total_persons", "errors", "duration", mode.alias("mode"))


def person_cards(persons: DataFrame) -> DataFrame:
    """One row per person; ``position`` is the place in the report, from 0."""
    told = F.col("description") if "description" in persons.columns else F.lit(None).cast("string")
    return persons.select(
        (F.col("id") - 1).alias("position"), F.concat(F.lit("Person "), F.col("id").cast("string")).alias("name"),
        "thumbnail", "photo_count", "face_count", F.coalesce(told, F.lit("")).alias("description"),
    )


def person_detail(persons: DataFrame, position: int) -> DataFrame:
    """Photos of the person at a place of the list, numbered from 0."""
    return persons.where(F.col("id") == position + 1).select(F.posexplode("photos").alias("photo_index", "photo"))


def error_list(errors: DataFrame) -> DataFrame:
    """``number, path, error`` in order of paths, one row a path."""
    return with_position(error_table(errors), "number", F.asc("path")).select("number", "path", "error")
