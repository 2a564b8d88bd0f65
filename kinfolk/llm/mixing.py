"""Mixing sources to target weights (operator 10), in built-in functions only.

Documents of a source are put in the order of a hash of their id. The distributed prefix sum works on ranges, the
leading digits of the hash, of some ``RANGE_ROWS`` rows: their sizes are summed up before any shuffle, then prefix sums
over ranges of ranges and over the ranges of one of these find the range in which a source's budget ends. The mix
cuts exactly there: whole epochs first, then the ranges before the cut, and a window over the rows of that one range.
All other rows are decided by their source's row and their hash, so texts are not moved.

Targets: with sources by code point (null last) and weights cycling, source s gets ``min(cap_s, z *
weight_s)`` with cap three times its size and the one z that spends the total. Sorted by cap per weight, the capped
sources are a prefix, so z is a windowed expression and no loop is needed.

Cases: a null or empty text has size 0 and is never taken; very long texts are counted whole and cut by words; a source of
size 0 has target 0; null is a source of its own; repeated rows count each time (rows alike in id and size may swap places,
which changes no number; rows of one id share a range, whose window is one task if the cut falls there); no documents give no
rows. ``mix`` replaces columns named like its results and keeps all others; ``mixed_documents`` keeps every column, whatever its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions.scratch import materialize
from kinfolk.llm.common import WORD, table, word_count, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
RANGE_ROWS = 512
#: Sources of some 100 bytes each that are broadcast; more are joined.
BROADCAST_SOURCES = 50_000


def _key(id_col: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source`` and ``size``."""
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights) + 1))
    s = s.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("k", F.row_number().over(order))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(everything)
    s = s.withColumn("z", F.coalesce(first["level"], F.lit(0.0)))
    return s.select("source", "source_size", F.least("cap", F.col("z") * F.col("weight")).alias("target"))


def _digits(rows: int) -> int:
    return max(0, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 16)))


def _places(d: DataFrame, id_col: str, digits: int) -> DataFrame:
    key = _key(F.col(id_col))
    return d.select("*", key.alias("__key"), F.substring(key, 1, digits).alias("__range"), F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source"))


SOURCE = ["__null", "__source"]


def _holding(sums: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of ``sums`` (in ``order`` within ``by``) the row in which the last epoch's budget ``__left`` ends; what is left of it there."""
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = sums.withColumn("__before", before).where((F.col("__before") <= F.col("__left")) & (F.col("__left") < F.col("__before") + F.col("__sum")))
    return held.withColumn("__left", F.col("__left") - F.col("__before")).drop("__before", "__sum")


def cuts(slim: DataFrame, rows: int, id_col: str = "doc_id", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: its size and target, whole epochs, and the hash range in which the last epoch ends, with the
    words left for that range. ``slim`` has ``id_col``, ``source`` and ``size`` and is read once."""
    digits = _digits(rows)
    sums = materialize(_places(slim, id_col, digits).groupBy(*SOURCE, "__range").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("__sum")))
    goal = targets(sums.select(F.when(~F.col("__null"), F.col("__source")).alias("source"), F.col("__sum").alias("size")), weights, max_epochs)
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.floor(budget / F.greatest("source_size", F.lit(1)))
    goal = goal.select(
        F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source"), "source_size", "target",
        epochs.alias("__epochs"), (budget - epochs * F.col("source_size")).alias("__left"),
    )
    goal = materialize(goal)
    # ranges are summed up in two steps, so that no task sees more than some square root of a source's ranges
    high = F.substring("__range", 1, (digits + 1) // 2)
    rough = sums.groupBy(*SOURCE, high.alias("__high")).agg(F.sum("__sum").alias("__sum"))
    rough = _holding(rough.join(goal.select(*SOURCE, "__left"), SOURCE), SOURCE, "__high")
    fine = sums.withColumn("__high", high).join(rough, [*SOURCE, "__high"])
    fine = _holding(fine, SOURCE, "__range").select(*SOURCE, F.col("__range").alias("__cut"), F.col("__left").alias("__rest"))
    return goal.drop("__left").join(fine, SOURCE, "left")


def _dealt(d: DataFrame, by_source: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows outside the range that holds their source's cut, with ``__part`` (whether the last epoch takes them whole), and the rows inside."""
    few = by_source.count() <= BROADCAST_SOURCES
    d = d.join(F.broadcast(by_source) if few else by_source, SOURCE)
    at_cut = F.coalesce(F.col("__range") == F.col("__cut"), F.lit(False))
    outside = d.where(~at_cut).withColumn("__part", F.coalesce(F.col("__range") < F.col("__cut"), F.lit(False)))
    return outside, d.where(at_cut)


def _parts(inside: DataFrame, id_col: str) -> DataFrame:
    """Rows of the cut ranges with ``__part``: how many of their words the last epoch takes."""
    order = W.partitionBy(*SOURCE).orderBy("__key", id_col, "size").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(order), F.lit(0))
    return inside.withColumn("__part", F.least(F.greatest(F.col("__rest") - at, F.lit(0)), F.col("size")))


def mix(sized: DataFrame, rows: int, id_col: str = "doc_id", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to rows with ``source`` and ``size``; columns of these names are replaced.

    ``rows`` is their number, which sets the width of the hash ranges and nothing else. ``sized`` is read
    three times: pass a table. Only rows of the cut ranges are moved.
    """
    sized = sized.drop("source_size", "target", "taken")
    by_source = materialize(cuts(sized.select(id_col, "source", "size"), rows, id_col, weights, max_epochs))
    outside, inside = _dealt(_places(sized, id_col, _digits(rows)), by_source, id_col)
    outside = outside.withColumn("__part", F.when(F.col("__part"), F.col("size")).otherwise(F.lit(0).cast("bigint")))
    d = outside.unionByName(_parts(inside, id_col))
    taken = (F.col("__epochs") * F.col("size") + F.col("__part")).cast("bigint")
    return d.select(*[F.col(f"`{c}`") for c in sized.columns], "source_size", "target", taken.alias("taken"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(sized, sized.count()).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: whole copies for whole epochs, a last copy cut after the words still due.

    All columns stay as they are, whatever their names; where a text is cut, ``n_chars`` follows it. Texts are read where they
    lie: rows outside the cut ranges need their source's row only.
    """
    size = word_count(F.col("text"))
    slim = materialize(docs.select("doc_id", "source", size.alias("size")))
    rows = slim.count()
    by_source = materialize(cuts(slim, rows))
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    outside, inside = _dealt(_places(packed, "doc_id", _digits(rows)), by_source, "doc_id")
    none = F.lit(None).cast("bigint")
    some = F.coalesce(F.col("__row.text").rlike(WORD), F.lit(False))
    whole = F.array_repeat(none, (F.col("__epochs") + F.col("__part").cast("bigint")).cast("int"))
    outside = outside.where(some).select("__row", F.explode(whole).alias("__cut"))
    inside = _parts(inside.withColumn("size", word_count(F.col("__row.text"))), "doc_id").where("size > 0")
    full = F.col("__part") == F.col("size")
    last = F.when((F.col("__part") > 0) & ~full, F.array(F.col("__part"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.array_repeat(none, (F.col("__epochs") + full.cast("bigint")).cast("int")), last)
    each = outside.unionByName(inside.select("__row", F.explode(copies).alias("__cut")))
    due = F.col("__cut").isNull()
    text = F.col("__row.text")
    short = F.array_join(F.slice(words(text), 1, F.col("__cut").cast("int")), " ")
    new = {"text": F.when(due, text).otherwise(short)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(due, F.col("__row.n_chars")).otherwise(F.length(short).cast(docs.schema["n_chars"].dataType))
    return each.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight, {MAX_EPOCHS} * source_size::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened, (sum(source_size) OVER ())::DOUBLE AS total FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT *, (total - capped) / opened AS level FROM r),
z AS (SELECT coalesce(arg_min(level, k) FILTER (level <= ratio), 0) AS z FROM l),
t AS (SELECT source, source_size, least(cap, z * weight)::DOUBLE AS target FROM l, z),
p AS (SELECT d.*, source_size, target, floor(target + 1e-6)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((budget // greatest(source_size, 1)) * size + least(greatest(budget - (budget // greatest(source_size, 1)) * source_size - pos, 0), size))::BIGINT AS taken FROM p
"""

QUERIES = {"op10_source_mix": op10_source_mix}
ORACLES = {"op10_source_mix": ORACLE}
