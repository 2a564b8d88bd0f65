"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is a function of ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next stage's documents. All stages but the last return the columns of ``documents``. A stage works on
whole texts and on every row that its predecessor kept. In every stage a null or empty text is a text of no words, very long
texts are worked on whole, repeated rows are rows of their own unless said otherwise, an empty table gives an empty one with the same columns, and
columns of the input keep their values whatever their names. Stages that run Python lower the session's limit on the bytes of rows that go
to a worker at once (``small_batches``), as whole texts, and ids beside them, would else fill an executor's memory outside its heap.

Some stage results follow no SQL (a trained classifier, MinHash candidates, tokenization), so ``ORACLE_SQL`` is None;
the tests compare each stage with a plain version on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.functions.scratch import materialize, scratch_scope
from kinfolk.llm import mixing, neardup, packing, secrets, toxicity
from kinfolk.llm.common import small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its cut; it learns from the labels outside the held-out third.

    A document without words scores by the model's bias; without labels of both classes all score alike: the share of toxic ones. Repeated rows share their fate.
    """
    small_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Texts are near with four fifths of their five-word shingles in common; five are the rule for stages, where the query of this
    operator has four by its contract. Documents without words stay, as do rows without an id, which nothing can stand for. Rows
    alike in all columns (maps aside, which cannot be compared) count once; rows of one id with different texts are kept or go together.
    """
    small_batches(spark)
    verdict = materialize(neardup.near_duplicates(docs.select("doc_id", "text"), k=5))
    by_id = verdict.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    dropped = materialize(by_id.where("not kept").select("doc_id"))
    small = dropped.count() <= neardup.BROADCAST_IDS
    left = docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if by_id.where("n > 1").isEmpty():
        return left
    return left.dropDuplicates([c for c, kind in left.dtypes if "map<" not in kind and kind != "variant"])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: copies for its epochs, the last one cut at the source's budget."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset."""
    small_batches(spark)
    return packing.pack(materialize(packing.pieces(docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. What a stage leaves in the scratch folder goes when its result is
    written, and that result when the next one is; the last stage's tables stay, as its rows are still to be read."""
    docs, written = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch_scope(spark) as own:
            docs = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                own.clear()
                return docs
            docs = materialize(docs)
            result = own.pop()
            own += [written] if written else []
        written = result
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
