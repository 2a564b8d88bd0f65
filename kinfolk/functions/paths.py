"""Path columns: names, extensions and the order of a directory walk (SRC2, SORT2, MAP10, MAP11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Final suffix of the name with its dot, lower-case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def stem(path: Column) -> Column:
    """Name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def walk_order(path: Column) -> Column:
    """Sort key that orders paths as a lexical walk of their directories does."""
    return F.split(path, "/")


def thumbnail_name(path: Column, face_idx: Column) -> Column:
    return F.concat(stem(path), F.lit("_face_"), face_idx.cast("string"), F.lit(".jpg"))


def unique_thumbnail_name(path: Column, face_idx: Column) -> Column:
    """As ``thumbnail_name``, with a hash of the whole path, so that equal stems do not collide."""
    return F.concat(stem(path), F.lit("_"), F.substring(F.sha2(path, 256), 1, 12), F.lit("_face_"), face_idx.cast("string"), F.lit(".jpg"))


def photo_reference(person_id: Column, path: Column) -> Column:
    return F.concat(F.lit("Person_"), person_id.cast("string"), F.lit("/"), basename(path))
