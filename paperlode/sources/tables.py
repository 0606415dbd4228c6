"""Parquet table sources with declared schemas (no inference pass, no time-zone shift)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Timestamps carry no zone in the files, so they stay TIMESTAMP_NTZ in Spark.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table below `base`, stored as `<name>.parquet` (a file or a folder)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{base.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, base: str, register: bool = False) -> dict[str, DataFrame]:
    """All tables, optionally registered as temp views for `spark.sql`."""
    tables = {name: load_table(spark, base, name) for name in SCHEMAS}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def version_of(df: DataFrame) -> tuple:
    """What tells one state of a table's files from another: how many rows they have, and a sum over names, sizes and times."""
    about = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    found = df.select(about.alias("file")).agg(F.count("*").alias("n"), F.sum(F.pmod("file", F.lit(1 << 31))).alias("files"))
    return tuple(found.first())
