"""Extraction records from JSON text (SRC6, SRC7, MAP1-MAP6; rules S11-S13).

An embedding is base64 of 32-bit floats, an array of numbers or null (empty); only VARIANT tells these apart exactly. A line
that is no record, or holds a face that cannot be decoded, counts as a whole: it is skipped, or an error of its
file, as ``on_bad_record`` says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.functions.codec import decode_floats, float_bytes

LOGGED_BYTES = 200


@dataclass(frozen=True)
class Extracted:
    faces: DataFrame  # file_path, face_idx, bbox, embedding, det_score, thumbnail
    file_errors: DataFrame  # path, error
    skipped: DataFrame  # text of skipped lines, cut for logs
    processed: DataFrame  # path of every record


def _face(f: Column) -> Column:
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(f, "$.embedding", "variant")), F.lit("MISSING"))
    text = F.try_variant_get(f, "$.embedding", "string")
    numbers = F.try_variant_get(f, "$.embedding", "array<double>")
    kinds = F.transform(F.try_variant_get(f, "$.embedding", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")))
    odd = F.exists(kinds, lambda k: k.rlike("^(STRING|BOOLEAN|ARRAY|OBJECT)"))
    numbers = F.when(~odd, F.transform(numbers, lambda x: F.coalesce(x, F.lit(0.0))))  # a null counts as zero
    array = F.when(kind == "VOID", F.array().cast("array<double>")).when(kind.startswith("ARRAY"), numbers)
    return F.struct(
        F.try_variant_get(f, "$.bbox", "array<double>").alias("bbox"),
        F.when(kind == "STRING", text).alias("text"),
        array.alias("numbers"),
        F.coalesce(F.try_variant_get(f, "$.det_score", "double"), F.lit(0.0)).alias("det_score"),
        F.coalesce(F.try_variant_get(f, "$.thumbnail", "string"), F.lit("")).alias("thumbnail"),
        F.when(kind == "STRING", float_bytes(text).isNotNull()).otherwise(array.isNotNull()).alias("good"),
    )


def parse_extractions(lines: DataFrame, on_bad_record: str = "skip", path_col: str | None = None) -> Extracted:
    """Parse ``lines(value)``. ``path_col`` names the file of a document that does not name it itself."""
    own = F.col(path_col) if path_col else F.lit(None).cast("string")
    p = lines.select("value", own.alias("given"), F.try_parse_json("value").alias("v"))
    p = p.withColumn("object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    raw = F.try_variant_get(F.col("v"), "$.faces", "array<variant>")
    p = p.select(
        "value", "object",
        F.coalesce("given", F.try_variant_get(F.col("v"), "$.file", "string")).alias("path"),
        F.coalesce(F.try_variant_get(F.col("v"), "$.error", "string"), F.lit("")).alias("error"),
        F.transform(F.coalesce(raw, F.array().cast("array<variant>")), _face).alias("faces"),
    )
    good = F.col("object") & F.forall("faces", lambda f: f["good"])
    failed = good & (F.col("error") != "")
    fine = p.where(good & (F.col("error") == ""))
    faces = fine.select(F.col("path").alias("file_path"), F.posexplode("faces").alias("face_idx", "f"))
    bbox = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get("f.bbox", i), F.lit(0.0)))
    faces = faces.select(
        "file_path", "face_idx", bbox.alias("bbox"), F.coalesce("f.numbers", decode_floats(F.col("f.text"))).alias("embedding"),
        F.col("f.det_score").alias("det_score"), F.col("f.thumbnail").alias("thumbnail"),
    )
    errors = p.where(failed).select("path", "error")
    skipped = p.where(~good)
    if on_bad_record == "error":
        errors = errors.unionByName(skipped.select("path", F.lit("json decode error").alias("error")))
        skipped = skipped.limit(0)
    return Extracted(faces, errors, skipped.select(F.make_valid_utf8(F.substring(F.col("value").cast("binary"), 1, LOGGED_BYTES).cast("string")).alias("value")), p.where(good).select("path"))


def read_extractions(spark: SparkSession, path: str, on_bad_record: str = "skip") -> Extracted:
    """Records of JSON-lines files."""
    return parse_extractions(spark.read.text(path), on_bad_record)


def read_documents(spark: SparkSession, path: str) -> Extracted:
    """One JSON document to a file; one that cannot be read is an error of that file."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_extractions(whole, "error", "path")
