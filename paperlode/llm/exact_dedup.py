"""Exact duplicates by a tree of merges over sorted digest runs.

Every input partition yields a run: its distinct digests with the best row and the number of rows of each.
In each round, `fan_in` neighbouring runs become one, as in a binomial tree of that degree: Spark's exchange brings them
into one task and its sort makes one order of them. Equal digests meet there and leave as one entry, whose identifier
is verified: a second digest of the text goes along through every level, and entries that agree in the first
and not in the second end the job. Runs are cut into shards by digest, so the last round has one run a
shard and no task ever holds all digests. A digest with any number of copies is one entry in each run it reaches.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlode.llm.common import pieces, stored, text_or_empty

#: Runs that the tree starts from (partitions beyond it share a run) and the part of the digest space a task merges.
RUNS, SHARDS = 512, 65_536
ENTRY = ("digest",)


@F.arrow_udf(T.StructType().add("digest", T.BinaryType()).add("second", T.BinaryType()))
def _digests(text: pa.Array) -> pa.Array:
    """SHA-256 of the normal form, and a short digest of it by another function."""
    first, second = [], []
    for part in pieces(text.cast(pa.binary())):
        for t in part.to_pylist():
            low = t.lower()  # bytes.lower() changes A-Z only, which is the normal form wanted here
            first.append(hashlib.sha256(low).digest())
            second.append(hashlib.blake2b(low, digest_size=12).digest())
    return pa.StructArray.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary())], ["digest", "second"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, digest, second, shard, run) of every row; a null text counts as empty."""
    text = text_or_empty(F.col(text_col))
    run = F.pmod(F.spark_partition_id(), F.lit(RUNS))
    return (
        docs.select(F.col(id_col).alias("doc_id"), _digests(text).alias("d"), F.xxhash64(text).alias("text_hash"))
        .select("doc_id", "d.*", "text_hash")
        .select("*", F.monotonically_increasing_id().alias("row"), run.alias("run"),
                F.pmod(F.xxhash64("digest"), F.lit(SHARDS)).cast("int").alias("shard"))
    )


def merge_runs(entries: DataFrame, keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """(digest, keep_id, keep_row, copies): the row that stays of each text and how many rows have it.

    Fails if texts with one digest have different second digests, wherever in the tree they meet.
    `best` is (doc_id, row). Of equal ids the row that was read first stays; a null id loses to any other.
    """
    if keep == "largest":
        choose, known, row = F.max, F.col("doc_id").isNotNull(), -F.col("row")
    else:
        choose, known, row = F.min, F.col("doc_id").isNull(), F.col("row")
    best = F.struct(known.alias("known"), "doc_id", row.alias("row"))
    key = ["shard", "run", *ENTRY]
    pick = [choose("best").alias("best"), F.sum("copies").alias("copies"), F.min("least").alias("least"), F.max("most").alias("most")]
    # the first round merges inside the tasks that read the rows; only distinct digests of a run leave them
    runs = entries.select(*key, F.col("second").alias("least"), F.col("second").alias("most"), best.alias("best"), F.lit(1).cast("long").alias("copies")).groupBy(*key).agg(*pick)
    left = RUNS
    while left > 1:
        left = -(-left // fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition("shard", "run")
            .sortWithinPartitions(*key)
            .groupBy(*key)
            .agg(*pick)
        )
    # row numbers are never negative, so the sign that turned them around goes again
    differs = F.raise_error(F.lit("texts with one digest differ in their second digest")).cast("binary")
    verified = F.when(F.col("least") == F.col("most"), F.col("digest")).otherwise(differs)
    return runs.select(verified.alias("digest"), F.col("best.doc_id").alias("keep_id"), F.abs("best.row").alias("keep_row"), "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and text_hash of the text as it is.

    Texts are equal when they agree after lower-casing A-Z; null equals the empty text. `keep` chooses the smallest
    or the largest id. Of rows that repeat both id and text exactly one is kept; rows without an id are kept
    only in a group where no row has one. Other columns are ignored, an empty table gives no rows.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    # stored, so that the join below exchanges both sides and the adaptive planner can split a hot digest
    winners = merge_runs(rows, keep)
    return rows.join(winners, list(ENTRY)).select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )
