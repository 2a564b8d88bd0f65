"""Every stage on its own input, in order, against plain versions."""

import importlib.util
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfolk.functions.scratch import scratch_dir

corpus = importlib.import_module("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
if corpus is None:
    pytest.skip("no pipeline", allow_module_level=True)

from kinfolk.llm import toxicity  # noqa: E402
from kinfolk.llm.common import BATCH_BYTES, BATCH_SETTING  # noqa: E402
from tests.llm.helpers import ODD, documents, edited, folder, prose  # noqa: E402
from tests.llm.test_models import labelled  # noqa: E402
from tests.llm.test_text_sets import brute_components  # noqa: E402


def table_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, tmp_path):
    rows, labels = labelled(120, 7)
    rows += [(300 + i, edited(rows[0][1], i, 0.01)) for i in range(10)] + ODD
    rows += [(400, prose(4, 60) + " password=hunter2222 " + prose(5, 10))]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    path = folder(spark, tmp_path / "t", rows, labels=lab)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus.STAGES] == ["toxicity", "minhash_neardup", "secret_scans", "source_mix", "packing"]
    seen = {}
    for name, stage in corpus.STAGES:
        before, docs = docs, corpus.materialize(stage(spark, docs, path))
        seen[name] = (before, docs)
        assert docs.columns == columns or name == "packing"

    before, after = seen["toxicity"]
    model = toxicity.train(before, lab)
    want = [tuple(r)[:-1] for r in toxicity.score(before, model).where("score < 0.7").collect()]
    assert table_of(after) == sorted(want, key=str)

    before, after = seen["minhash_neardup"]
    kept = {i for i, _, _, k in brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80) if k}
    assert table_of(after) == sorted({tuple(r) for r in before.collect() if r.doc_id in kept}, key=str)

    before, after = seen["secret_scans"]
    assert before.count() == after.count()
    by = {r.doc_id: r.text for r in after.collect()}
    assert "hunter2222" not in by[400] and "[redacted]" in by[400]

    before, after = seen["source_mix"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    total = sum(len((r.text or "").split()) for r in before.collect())
    assert abs(sum(len(r.text.split()) for r in after.collect()) - total) <= 3

    before, after = seen["packing"]
    whole = {(r.doc_id, r.doc_tokens) for r in after.collect()}
    assert {i for i, _ in whole} == {r.doc_id for r in before.collect()}


def test_run_equals_stages(spark, data):
    assert corpus.run(spark, data).count() > 0


def test_a_run_deletes_what_it_is_done_with(spark, data):
    """What is left is the last stage's input and tables."""
    folder_ = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder_))
    out = corpus.run(spark, data)
    left = set(os.listdir(folder_)) - before
    assert out.count() > 0 and len(left) == 2


NAMES = ["size", "source_size", "target", "taken", "score", "__score", "__part", "__cut", "__row", "__range", "kept", "component_id", "base", "ids", "rank"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows, labels = labelled(60, 3)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    path = folder(spark, tmp_path / "t", rows[:1], labels=lab)
    docs = documents(spark, [*rows, (None, None), (None, prose(1, 20)), (70, "")]).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    docs = docs.withColumns({n: F.concat(F.lit(f"my {n} "), F.col("doc_id").cast("string")) for n in NAMES}).cache()
    had = {tuple(r[n] for n in ["doc_id", *NAMES]) for r in docs.collect()}
    for title, stage in corpus.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, title
        found = out.collect()
        assert {tuple(r[n] for n in ["doc_id", *NAMES]) for r in found} <= had and len(found) > 30, title


def test_stages_on_nothing(spark, tmp_path):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    path = folder(spark, tmp_path / "t", [], labels=lab)
    assert corpus.run(spark, path).count() == 0


def test_repeated_rows_count_once(spark):
    d = documents(spark, [(1, prose(1, 30)), (1, prose(1, 30)), (2, prose(2, 30)), (2, prose(3, 30))])
    assert table_of(corpus.drop_near_duplicates(spark, d, "")) == sorted({tuple(r) for r in d.collect()}, key=str)


def test_packed_sequences_hold_the_ids(spark):
    tok = corpus.packing.WordTokenizer(corpus.packing.vocabulary_path())
    texts = {1: prose(1, 30), 2: prose(2, 3000), 3: None, 4: prose(4, 500)}
    d = documents(spark, [*texts.items(), (1, texts[1])])
    sequences, pieces = {}, {}
    for r in corpus.pack_sequences(spark, d, "").collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, ids))
        pieces.setdefault(r.doc_id, []).append((r.start, ids))
    for parts in sequences.values():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
    want = {i: [*tok.ids(t or "").tolist(), corpus.packing.END_ID] for i, t in texts.items()}
    assert sorted(pieces.pop(1)) == [(0, want[1])] * 2
    for i, parts in pieces.items():
        assert sum((ids for _, ids in sorted(parts)), []) == want[i]
    assert set(pieces) == {2, 3, 4}


def batch_bytes(spark):
    """Bytes of the batches in which 12 MB of rows go to a worker."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    rows = spark.range(6000, numPartitions=1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    return [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]


@pytest.mark.parametrize("name", ["toxicity", "minhash_neardup", "packing"])
def test_python_stages_send_small_batches(spark, tmp_path, name):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    path = folder(spark, tmp_path / "t", [(1, prose(1, 20))], labels=lab)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus.STAGES)[name]
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.unset(BATCH_SETTING)
        assert max(batch_bytes(spark)) > 11 << 20
        stage(spark, docs, path)
        found = batch_bytes(spark)
        assert max(found) < BATCH_BYTES + 10_000 and sum(found) >= 12_000_000
        spark.conf.set(BATCH_SETTING, "1m")
        stage(spark, docs, path)
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(BATCH_SETTING, before)
