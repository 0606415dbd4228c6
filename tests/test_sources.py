"""File sources, sinks, the shared folder, and streaming ingest."""

import hashlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from paperlode.session import shared_dir
from paperlode.sources import files as FS
from paperlode.sources.tables import SCHEMAS, load_table, load_tables
from paperlode.streaming import ingest as SI
from tests.conftest import SMALL


def test_tables_have_declared_types(spark):
    tables = load_tables(spark, SMALL, register=True)
    assert set(tables) == set(SCHEMAS)
    assert spark.sql("SELECT count(*) AS n FROM region").first().n == 5
    assert dict(tables["events"].dtypes)["ts"] == "timestamp_ntz"


def test_scan_prunes_and_pushes(spark):
    plan = load_table(spark, SMALL, "lineitem").where("l_quantity > 40").select("l_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in text and "l_comment" not in text and "l_tax" not in text


def test_bytes_and_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.bin").write_bytes(b"two")
    (tmp_path / "c.txt").write_bytes(b"skip")
    files = FS.read_bytes(spark, str(tmp_path), "*.bin")
    assert {r.length for r in files.collect()} == {3} and files.count() == 2
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in files.collect()}
    expected = spark.createDataFrame(
        [
            (paths["a.bin"], hashlib.sha256(b"one").hexdigest()),
            (paths["b.bin"], hashlib.sha256(b"TWO").hexdigest()),
            ("file:/gone", "0" * 64),
        ],
        "path string, sha256 string",
    )
    states = {r.path: r.state for r in FS.check_digests(files, expected).collect()}
    assert states == {paths["a.bin"]: "ok", paths["b.bin"]: "changed", "file:/gone": "missing"}


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{\n "id": 1,\n "tags": ["a", "b"],\n "meta": {"k": "v"}\n}')
    schema = "id bigint, tags array<string>, meta struct<k:string>"
    df = FS.read_json(spark, str(tmp_path / "in"), schema)
    FS.write_json(df, str(tmp_path / "out"))
    assert spark.read.schema(schema).json(str(tmp_path / "out")).collect() == df.collect()


def test_shared_dir_is_below_the_configured_folder(spark):
    one, two = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


@pytest.fixture
def feed(spark, tmp_path):
    def write(name, rows):
        df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint")
        df = df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")
        out = df.select(
            "event_id", "ts", "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")
        )
        out.coalesce(1).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))

    return tmp_path, write


def test_ingest_stores_each_key_once_across_restarts(spark, feed):
    tmp_path, write = feed
    base, path = str(tmp_path / "in"), str(tmp_path / "table")

    def run():
        SI.ingest_new(SI.stream_table(spark, base, "events", max_files=1), path, "event_id").awaitTermination()
        return sorted(r.event_id for r in spark.read.schema(SCHEMAS["events"]).parquet(f"{path}/data").collect())

    write("events1", [(1, "2024-01-01 00:00:00", 5), (2, "2024-01-01 00:00:01", 5), (2, "2024-01-01 00:00:01", 5)])
    assert run() == [1, 2]
    # A repeat, a new key, and a new key far older than everything seen.
    write("events2", [(2, "2024-01-01 00:00:01", 5), (3, "2024-01-02 00:00:00", 5), (4, "2001-01-01 00:00:00", 5)])
    assert run() == [1, 2, 3, 4]
    assert run() == [1, 2, 3, 4]


def test_null_keys_are_stored_once(spark, feed):
    tmp_path, write = feed
    path = str(tmp_path / "table")
    for n in (1, 2):
        write(f"events{n}", [(None, "2024-01-01 00:00:00", 5), (None, "2024-01-01 00:00:01", 5), (n, "2024-01-01 00:00:02", 5)])
        SI.ingest_new(SI.stream_table(spark, str(tmp_path / "in"), "events", 1), path, "event_id").awaitTermination()
    stored = spark.read.schema(SCHEMAS["events"]).parquet(f"{path}/data")
    assert sorted(r.event_id or 0 for r in stored.collect()) == [0, 1, 2]


def test_watermark_dedup(spark, feed):
    tmp_path, write = feed
    write("events1", [(1, "2024-01-01 00:00:00", 5), (1, "2024-01-01 00:00:30", 5), (2, "2024-01-01 00:00:40", 5)])
    stream = SI.first_seen(SI.stream_table(spark, str(tmp_path / "in"), "events"), ["event_id"], "ts", "10 minutes")
    SI.run_to_table(stream, str(tmp_path / "out")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect()) == [1, 2]


def test_helpers_travel_without_the_package(tmp_path):
    from pyspark import cloudpickle

    from paperlode.functions.stemming import stem_word

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(stem_word))
    code = "import pickle; print(pickle.load(open('f.pkl', 'rb'))('motoring'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={})
    assert out.stdout.strip() == "motor", out.stderr
