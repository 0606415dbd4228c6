"""File sources and sinks beyond tables: raw bytes with digests, and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of each file. Spark holds one file in one row, so a file must stay below 2 GB."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )


def check_digests(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare stored digests (path, sha256) with the files: ok, changed, or missing."""
    actual = files.select("path", F.sha2("content", 256).alias("actual"))
    state = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok").otherwise("changed")
    )
    return expected.join(actual, "path", "left").select("path", state.alias("state"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file, with a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
