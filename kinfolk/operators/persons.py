"""Persons from components: counts, photos, best thumbnail and rank (AGG1-AGG5, SORT1, RANK1, SET1).

Aggregations are by component and combine before they are shuffled; a component of any size is counted in parts. The
one per-person list is of photos, which is the result itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.paths import photo_reference
from kinfolk.functions.ranking import with_position


def person_ranks(clusters: DataFrame) -> DataFrame:
    """``id, component_id, face_count``: persons numbered by face count, descending, then by component."""
    sizes = clusters.groupBy("component_id").agg(F.count("*").alias("face_count"))
    return with_position(sizes, "id", F.desc("face_count"), F.asc("component_id")).select("id", "component_id", "face_count")


def person_photos(clusters: DataFrame) -> DataFrame:
    """``component_id, file_path, first_seen``: each photo of a component once, by full path."""
    return clusters.groupBy("component_id", "file_path").agg(F.min("face_id").alias("first_seen"))


def best_thumbnails(clusters: DataFrame) -> DataFrame:
    """``component_id, thumbnail`` of the highest score above 0; the first face wins ties."""
    usable = clusters.where((F.coalesce("thumbnail", F.lit("")) != "") & (F.col("det_score") > 0) & ~F.isnan("det_score"))
    best = F.max_by("thumbnail", F.struct(F.col("det_score"), -F.col("face_id")))
    return usable.groupBy("component_id").agg(best.alias("thumbnail"))


def persons(faces: DataFrame, components: DataFrame) -> DataFrame:
    """One row per person: ``id, component_id, photo_count, face_count, thumbnail, photos``.

    ``faces`` has ``face_id, file_path, det_score, thumbnail``; ``photos`` are references in first-seen order.
    """
    clusters = components.join(faces.select("face_id", "file_path", "det_score", "thumbnail"), "face_id")
    photos = person_photos(clusters).groupBy("component_id").agg(
        F.count("*").alias("photo_count"),
        F.array_sort(F.collect_list(F.struct("first_seen", "file_path"))).alias("seen"),
    )
    p = person_ranks(clusters).join(photos, "component_id").join(best_thumbnails(clusters), "component_id", "left")
    listed = F.transform("seen", lambda x: photo_reference(F.col("id"), x["file_path"]))
    return p.select("id", "component_id", "photo_count", "face_count", F.coalesce("thumbnail", F.lit("")).alias("thumbnail"), listed.alias("photos"))


def multi_person_photos(faces: DataFrame, components: DataFrame) -> DataFrame:
    """``file_path, persons`` of photos that show more than one person."""
    seen = components.join(faces.select("face_id", "file_path"), "face_id").select("file_path", "component_id").distinct()
    return seen.groupBy("file_path").agg(F.count("*").alias("persons")).where("persons > 1")
