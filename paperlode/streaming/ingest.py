"""Streaming ingest that stores each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlode.session import shared_dir
from paperlode.sources.tables import SCHEMAS

#: Parts of a stored table by hash of the key.
BUCKETS = 64


def stream_table(spark: SparkSession, base: str, name: str, max_files: int = 1000) -> DataFrame:
    """A table's files as a stream; files that arrive later are picked up by later triggers."""
    return (
        spark.readStream.schema(SCHEMAS[name])
        .option("maxFilesPerTrigger", max_files)
        .parquet(f"{base.rstrip('/')}/{name}*.parquet")
    )


def first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within `delay`; state older than the watermark is released."""
    # Watermarks need a zoned timestamp; the session's zone is UTC by default.
    zoned = stream.withColumn(event_time, stream[event_time].cast("timestamp"))
    return zoned.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str) -> StreamingQuery:
    """Drain what is available into parquet. The checkpoint beside it makes a restart resume, not repeat."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def ingest_new(stream: DataFrame, path: str, key: str) -> StreamingQuery:
    """Store each key once, however late its repeats come: every batch is compared with what is stored.

    Unlike `first_seen` this drops no late row and keeps no state but the table. The table is split by a hash of the
    key, and a batch reads the key column of only those parts that its own keys fall into. A batch overwrites
    its own folder, so a batch that is run again after a failure replaces itself. A null key is a key like
    any other and is stored once.
    """
    spark = stream.sparkSession
    table = f"{path}/data"
    columns = stream.schema
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")

    def store(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != key]
        # min_by merges repeats on the map side, so a key sent without end stays one row per task.
        once = batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("row"))
        fresh = once.select(key, "row.*").select(*batch.columns, bucket)
        if batch_id > 0:
            touched = [r.bucket for r in batch.select(bucket).distinct().collect()]
            schema = f"`{key}` {columns[key].dataType.simpleString()}, batch_id bigint, bucket int"
            stored = spark.read.schema(schema).parquet(table)
            stored = stored.where(F.col("bucket").isin(*touched) & (F.col("batch_id") < batch_id))
            stored = stored.select(F.col(key).alias("__key"))
            fresh = fresh.join(stored, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def ingest_once(spark: SparkSession, base: str, name: str, key: str) -> DataFrame:
    """Run `ingest_new` over the files that are there and return the stored table."""
    path = shared_dir(spark, f"stream-{name}")
    ingest_new(stream_table(spark, base, name), path, key).awaitTermination()
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/data")
