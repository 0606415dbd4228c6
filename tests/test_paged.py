"""The source of numbered pages."""

import json

from paperlode.sources import paged
from paperlode.streaming.ingest import run_to_table

SCHEMA = "id bigint, name string, value double"


def write(folder, number, *pages):
    where = folder / f"page={number}"
    where.mkdir(parents=True)
    (where / "part.json").write_text("\n".join(json.dumps({"items": p}) for p in pages) + "\n\n")
    (where / "_SUCCESS").write_text("")


def test_batch_and_stream(spark, tmp_path):
    paged.register(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    address = f"file://{folder}"

    def table(n=2):
        return sorted(map(tuple, spark.read.format("paged").schema(SCHEMA).option("pagesPerPartition", n).load(address).collect()))

    def streamed():
        stream = spark.readStream.format("paged").schema(SCHEMA).load(address)
        run_to_table(stream, out).awaitTermination()
        return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(f"{out}/data").collect()))

    assert table() == []
    write(folder, 0, [{"id": 1, "name": "é", "value": 1.5}, {"id": 2}], [{"id": 3, "more": "x", "name": None}])
    write(folder, 2, [])
    write(folder, 10, [{"id": 4, "value": 2.0}])
    first = [(1, "é", 1.5), (2, None, None), (3, None, None), (4, None, 2.0)]
    assert table() == table(1) == table(100) == first
    assert streamed() == first
    assert streamed() == first  # nothing new
    write(folder, 11, [{"id": 5}])
    assert streamed() == [*first, (5, None, None)] == table()
    reader = spark.read.format("paged").schema(SCHEMA).option("pagesPerPartition", 1).load(address)
    assert reader.rdd.getNumPartitions() == 4
