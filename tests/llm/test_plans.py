"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from kinfolk.llm import mixing, quality, secrets
from kinfolk.llm.common import table


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("query", [quality.op1_quality_rules, secrets.op9_secret_scans, mixing.op10_source_mix])
def test_native_plans_hold_no_python(spark, data, query):
    assert not re.search("Python|Pandas|Arrow", plan(query(spark, data)))


@pytest.mark.parametrize("query", [quality.op1_quality_rules, secrets.op9_secret_scans])
def test_projections_move_no_rows(spark, data, query):
    text = plan(query(spark, data))
    assert "Exchange" not in text and re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_mix_stages_hold_no_python(spark, data):
    docs = table(spark, data, "documents")
    assert not re.search("Python|Pandas|Arrow", plan(mixing.mixed_documents(docs)) + plan(secrets.redact(docs.withColumn("x", F.lit(1)))))
