"""Scans read what a query needs, and no more."""

import re

import pandas as pd

from kinfolk.operators import similarity
from kinfolk.operators.components import contracted_labels
from kinfolk.operators.persons import person_ranks
from kinfolk.plans import catalog


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scans_are_pruned(spark, data):
    text = plan(catalog.QUERIES["thumb_names"](spark, data))
    assert "ReadSchema: struct<vec_id:bigint>" in text and "Exchange" not in text
    assert "Python" not in text


def test_filters_reach_the_scan(spark, data):
    f = catalog.face_table(spark, data).where("face_id > 7").select("face_id")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(vec_id,7\)", plan(f))


def test_ranks_combine_before_the_shuffle(spark):
    c = spark.range(10).selectExpr("id AS face_id", "id % 3 AS component_id")
    assert plan(person_ranks(c)).count("partial_count") >= 1


def test_partitions_contract_before_one_task_does(spark):
    e = spark.range(100).selectExpr("id AS src", "id + 1 AS dst").repartition(4)
    text = plan(contracted_labels(e))
    assert "SinglePartition" in text and text.count("MapInPandas") >= 2
    assert contracted_labels(e).select("component_id").distinct().count() == 1


def test_similar_pairs_come_in_strips(monkeypatch):
    monkeypatch.setattr(similarity, "STRIP", 8)
    cell = pd.DataFrame({"i": 0, "j": 0, "block": 0, "face_id": range(40), "embedding": [[1.0, 0.0]] * 40})
    halves = iter([cell.iloc[:25], cell.iloc[25:]])
    got = list(similarity._cells(halves, -1.0))
    assert max(map(len, got)) <= 8 * 40 and sum(map(len, got)) == 40 * 39 // 2


def test_reports_gather_no_persons(spark, data):
    for name in ("report_cards", "report_stats", "report_detail"):
        assert not re.search(r"collect_list\((named_)?struct\(id", plan(catalog.QUERIES[name](spark, data)))
