"""Rows that decisions keep, and what a run leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperlode.llm import common
from paperlode.session import shared_dir
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, text string, lang string"


def decisions(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept boolean")
    return df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "kept")


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_one_of_very_many_equal_rows_stays(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    text = "the same text " * 20
    hot = spark.range(0, 100_000, 1, 12).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"))
    rest = spark.createDataFrame([(7, "other", "de"), (8, text, "en"), (None, None, None), (None, "", "fr"), (9, "gone", "en"), (10, "b", "x"), (10, "b", "y"), (10, "b", "z")], SCHEMA)
    table = decisions(spark, [(7, "other", True), (8, text, True), (None, None, True), (None, "", False), (9, "gone", False)] + [(10, "b", k) for k in (True, False, True)])
    table = table.unionByName(hot.select("doc_id", F.xxhash64("text").alias("text_hash"), (F.monotonically_increasing_id() == 5).alias("kept")))
    found = corpus_pipeline.keep_rows(hot.unionByName(rest), table)
    assert found.columns == ["doc_id", "text", "lang"]
    ids = sorted(((r.doc_id or 0), (r.text or "")[:5]) for r in found.collect())
    assert ids == [(0, ""), (7, "other"), (7, "the s"), (8, "the s"), (10, "b"), (10, "b")]


def test_a_run_leaves_only_its_result(spark):
    base = os.path.dirname(shared_dir(spark, "x"))
    before = set(os.listdir(base))
    result = corpus_pipeline.run(spark, SMALL)
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before} == {"pipeline-source_mixing"}
    assert result.count() > 0
