"""Dense positions in a global order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions.scratch import materialize

#: Up to so many rows one task ranks at once; above, ranges are ranked apart and shifted.
ONE_TASK_ROWS = 200_000
RANGE_ROWS = 100_000


def with_position(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``: 1 for the first row in ``order``, 2 for the next, ... The order must be total."""
    n = df.count()
    if n <= ONE_TASK_ROWS:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))
    parts = -(-n // RANGE_ROWS)
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifted = dealt.join(sizes.select("__part", before.alias("__before")), "__part")
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return shifted.withColumn(name, (F.col("__before") + place).cast("bigint")).drop("__part", "__before")
