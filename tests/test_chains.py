"""Chains that a stream continues."""

import hashlib

from pyspark.sql import functions as F

from paperlode.operators import integrity as I
from paperlode.streaming.chains import continued_chains
from paperlode.streaming.ingest import run_to_table

SCHEMA = "who string, at bigint, what string"


def chain(rows):
    tips, out = {}, []
    for who, at, what in rows:
        seq, prev = tips.get(who, (0, I.GENESIS))
        digest = hashlib.sha256((prev + what).encode()).hexdigest()
        tips[who] = (seq + 1, digest)
        out.append((who, at, seq + 1, prev, digest))
    return sorted(out)


def test_batches_continue_chains_and_repeats_add_nothing(spark, rows, tmp_path):
    first = [("a", 3, "x"), ("a", 1, "y"), ("b", 5, "é"), (None, 1, "n"), ("a", None, "n"), ("a", 2, None)]
    second = [("a", 4, "x"), ("b", 6, ""), ("b", 6, "z"), ("c", 1, "w"), ("a", 2, "late")]
    path = str(tmp_path)
    for batch in (first, first, second, second + first, []):
        rows(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        run_to_table(continued_chains(stream, "who", "at", F.col("what")), f"{path}/out").awaitTermination()
    found = spark.read.parquet(f"{path}/out/data")
    assert found.columns == ["who", "at", "seq", "prev_hash", "hash"]
    linked = [("a", 1, "y"), ("a", 3, "x"), ("a", 4, "x"), ("b", 5, "é"), ("b", 6, ""), ("c", 1, "w")]
    assert sorted(map(tuple, found.collect())) == chain(linked)

    log = found.join(rows(linked, SCHEMA), ["who", "at"])
    checked = I.verify_chain(log, "at", F.col("what"), keys=["who"]).collect()
    assert all(r.content_ok and r.pointer_ok for r in checked)
    altered = log.where("NOT (who = 'a' AND at = 3)").withColumn("what", F.when(F.col("who") == "c", "v").otherwise(F.col("what")))
    wrong = {(r.who, r.at): (r.content_ok, r.pointer_ok) for r in I.verify_chain(altered, "at", F.col("what"), keys=["who"]).collect()}
    assert {k for k, v in wrong.items() if v != (True, True)} == {("a", 4), ("c", 1)}
    assert wrong["a", 4] == (True, False) and wrong["c", 1] == (False, True)
