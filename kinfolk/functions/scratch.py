"""Shared scratch space: lineage is cut by writing a table, never by a local checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that every executor shares.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, and Spark runs in one
    process (tests), a temporary folder stands in for it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='scratch-')}")
    return sc.getCheckpointDir().rstrip("/")


#: Spark's setting that deletes a command's shuffle files at its end.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables written since each open scope began.
_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written meanwhile are deleted at the end, but for those whose paths are taken off the list that this gives.

    For steps that end with their result on disk: nothing that is still to run may read these tables.
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes[:] = [s for s in _scopes if s is not own]
        jvm = spark.sparkContext._jvm
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.

    The result survives the loss of any executor and carries no lineage, so that expensive steps
    (tokenizing, hashing whole texts) run once however often their rows are read. What was shuffled to make it is
    deleted as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    for scope in _scopes:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)
