"""A training corpus from raw documents: stages that each apply one operator of `paperlode.llm`."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlode.llm import chosen_path, decontaminate, exact_dedup, mixing, quality
from paperlode.llm.common import broadcast_if_small, released, stored, text_or_empty
from paperlode.operators.once import computed_once
from paperlode.sources.tables import load_table

#: Documents with a lower score than this are rejected.
QUALITY = 0.3
#: No source of the finished mix is used more often than this; the largest is used once.
REPETITION = 2.0


def _first_of_task(batches):
    """Of each key the first `keep_n` rows that a task reads; it remembers a number for each of its keys."""
    seen: Counter = Counter()
    for batch in batches:
        kept = []
        for *key, n in zip(*[batch.column(c).to_pylist() for c in ("keep_id", "keep_unknown", "keep_hash", "keep_n")]):
            seen[tuple(key)] += 1
            kept.append(seen[tuple(key)] <= n)
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of `docs` that `decisions` (doc_id, text_hash, kept) keeps, one decision for each row.

    Rows are matched by id and text, null ids included. Keys that are dropped altogether, usually the smaller part, go to
    the texts, so that no text is shuffled while they are few. Of rows that repeat id and text as many stay as
    decisions say: each task passes on as many at most, however many it reads, and the choice is made among these.
    """
    unknown = F.col("doc_id").isNull().alias("keep_unknown")
    key = [F.coalesce("doc_id", F.lit(0)).alias("keep_id"), unknown]
    names = ["keep_id", "keep_unknown", "keep_hash"]
    counted = decisions.select(*key, F.col("text_hash").alias("keep_hash"), F.col("kept").cast("int").alias("kept"))
    counted = counted.groupBy(*names).agg(F.sum("kept").alias("keep_n"), F.count("*").alias("keep_of"))
    partly = stored(counted.filter("keep_n < keep_of"), "dropped-keys")
    # the row goes along as one struct, so that no column of its own can clash with a key
    keyed = docs.select(F.struct("*").alias("keep_row"), *key, F.xxhash64(text_or_empty(F.col("text"))).alias("keep_hash"))
    whole = keyed.join(broadcast_if_small(partly.select(*names)), names, "left_anti").select("keep_row.*")
    some = partly.filter("keep_n > 0").drop("keep_of")
    if some.isEmpty():
        return whole
    line = Window.partitionBy(*names).orderBy("keep_hash")
    few = keyed.join(broadcast_if_small(some), names)
    few = few.mapInArrow(_first_of_task, few.schema)
    rows = few.withColumn("keep_place", F.row_number().over(line)).filter("keep_place <= keep_n")
    return whole.unionByName(rows.select("keep_row.*"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject. Each row is judged alone."""
    model = quality.fit(docs, load_table(spark, sf_dir, "labels"))
    stats = quality.statistics(text_or_empty(F.col("text")))
    scored = computed_once(docs.select(F.struct("*").alias("row"), "text"), ["row"], {"statistics": stats})
    return scored.filter(model.score(F.col("statistics")) >= QUALITY).select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z the row with the largest doc_id stays."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs, keep="largest"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id stays."""
    return keep_rows(docs, chosen_path.similar_documents(docs).withColumnRenamed("first", "kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty belong to a benchmark window."""
    named = docs.select(F.struct("doc_id", F.xxhash64(text_or_empty(F.col("text"))).alias("text_hash")).alias("key"), "text")
    found = decontaminate.contamination(named, load_table(spark, sf_dir, "benchmark"), doc_id="key")
    return keep_rows(docs, found.select("doc_id.*", (~F.col("contaminated")).alias("kept")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that a document gets in the mix, with its epoch and its place in the training order."""
    return mixing.permuted(docs, mixing.plan(docs, repetition=REPETITION))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Trained weights and seeded splits cannot be written as SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each reads what the one before it wrote, and what none reads any more is removed."""
    docs = load_table(spark, sf_dir, "documents")
    read: list[str] = []
    for name, stage in STAGES:
        with released(spark) as written:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            # this table stays for the next stage; the one that this stage read goes with the rest
            now = [written.pop()]
            written += read
        read = now
    return docs
