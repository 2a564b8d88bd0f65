"""Image files (SRC1-SRC4, SORT2)."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk import schema
from kinfolk.functions.paths import IMAGE_EXTENSIONS, is_image


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every image below a local folder, in walk order; links to folders are not followed.

    The root must be a folder; an error of the walk ends the scan.
    """
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)

    def fail(e: OSError) -> None:
        raise e

    found = [
        os.path.join(d, name)
        for d, _, names in os.walk(root, onerror=fail)
        for name in names
        if os.path.splitext("x" + name)[1].lower() in IMAGE_EXTENSIONS
    ]
    return spark.createDataFrame([(p,) for p in sorted(found, key=lambda p: p.split("/"))], schema.IMAGES)


def read_images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Images of any store that Spark reads, listed and read by the executors.

    Spark leaves out names that begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJpP]*").load(root)
    return files.where(is_image(F.col("path"))).select("path", *["content"] * content)


def one_image(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of a single image."""
    return spark.createDataFrame([(os.path.abspath(path),)], schema.IMAGES)


def read_listed(images: DataFrame) -> DataFrame:
    """``path, content`` of listed images, read by the executors from folders that they share; null where a file cannot be read."""

    def read(batches):
        for pdf in batches:
            for path in pdf.path:
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pd.DataFrame({"path": [path], "content": [content]})

    return images.select("path").mapInPandas(read, "path string, content binary")


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """``path`` from a text file of one path a line; blanks around are cut and empty lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
