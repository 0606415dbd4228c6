"""A stored index of three-character windows for substring and LIKE search, with every hit verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.operators.blocks import runs_of

GRAM = 3
#: Characters that a task holds as windows at once, unless a single text has more.
CHUNK = 1 << 21
#: How many of a pattern's windows, the rarest ones, are intersected before texts are read.
CHOSEN = 6


def _names(windows: np.ndarray) -> list[str]:
    """Windows as text, from numbers that hold 21 bits for each character."""
    chars = np.stack([windows >> 42, (windows >> 21) & 0x1FFFFF, windows & 0x1FFFFF], axis=1)
    joined = chars.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + GRAM] for i in range(0, len(joined), GRAM)]


def _listed(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(gram, ids, n): the texts that have each window of three characters, case and all; shorter texts have none."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    inside = np.flatnonzero(row[: -GRAM + 1] == row[GRAM - 1 :]) if len(row) >= GRAM else np.zeros(0, dtype=np.int64)
    windows = pa.array((chars[inside] << 42) | (chars[inside + 1] << 21) | chars[inside + 2]).dictionary_encode()
    # sorted, the distinct pairs of window and text are the lists, one after the other
    pairs = np.unique(windows.indices.to_numpy().astype(np.int64) * max(1, len(texts)) + row[inside])
    code, text = np.divmod(pairs, max(1, len(texts)))
    n = np.bincount(code, minlength=len(windows.dictionary)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), ids.take(pa.array(text)))
    return pa.RecordBatch.from_arrays([pa.array(_names(windows.dictionary.to_numpy()), pa.string()), lists, pa.array(n)], ["gram", "ids", "n"])


def _lists_by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists over runs of texts with some `CHUNK` characters together, or of one longer text."""
    for batch in batches:
        for start, end in runs_of(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False), CHUNK):
            yield _listed(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))


def write_gram_index(df: DataFrame, row_id: str, text: str, path: str, buckets: int = 64) -> None:
    """Store lists of ids for each window by bucket and sorted by window, and how many texts have each. Rows without id or text are left out.

    A task lists its texts by window before anything is shuffled, so a row that travels or is sorted stands for many texts.
    A window that very many texts have makes a large bucket, which the rebalance hint lets the adaptive planner cut.
    """
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
    rows = df.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(row_id, text)
    listed = rows.mapInArrow(_lists_by_task, f"gram string, ids array<{df.schema[row_id].dataType.simpleString()}>, n int")
    placed = listed.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = df.sparkSession.read.schema("gram string, n int, bucket int").parquet(f"{path}/postings")
    stored.groupBy("gram", "bucket").agg(F.sum("n").alias("n")).sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def literal_parts(pattern: str) -> list[str]:
    """The stretches of a LIKE pattern between its wildcards; a backslash makes the next character a plain one."""
    parts, now, at = [], "", 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\" and at + 1 < len(pattern):
            at += 1
            now += pattern[at]
        elif ch in "%_":
            parts.append(now)
            now = ""
        else:
            now += ch
        at += 1
    return [p for p in (*parts, now) if p]


def search_like(df: DataFrame, path: str, row_id: str, text: str, pattern: str) -> DataFrame:
    """The rows of `df` whose text is LIKE `pattern`, found through the index over the same rows.

    The rarest windows of the pattern's literal stretches are intersected; only texts that have all of them are tested.
    A pattern without a stretch of three characters has no windows: every text is tested then. Rows without an id
    are found only in that case.
    """
    spark = df.sparkSession
    wanted = sorted({p[i : i + GRAM] for p in literal_parts(pattern) for i in range(len(p) - GRAM + 1)})
    matching = df.where(F.col(text).like(pattern))
    if not wanted:
        return matching
    # one row for each window of the pattern
    known = spark.read.schema("gram string, bucket int, n bigint").parquet(f"{path}/grams").where(F.col("gram").isin(wanted)).collect()
    if len(known) < len(wanted):
        return df.limit(0)
    rarest = sorted(known, key=lambda r: (r.n, r.gram))[:CHOSEN]
    id_type = df.schema[row_id].dataType.simpleString()
    stored = spark.read.schema(f"ids array<{id_type}>, gram string, bucket int").parquet(f"{path}/postings")
    stored = stored.where(F.col("bucket").isin([r.bucket for r in rarest]) & F.col("gram").isin([r.gram for r in rarest]))
    stored = stored.select("gram", F.explode("ids").alias("id"))
    hits = stored.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest))
    return matching.join(hits.select(F.col("id").alias(row_id)), row_id, "left_semi")
