"""Block-wise ordered operators against plain Python, with a hot key, nulls and few or many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from paperlode.functions.times import epoch_micros
from paperlode.operators import joins as J
from paperlode.operators import ordered as O


def make(n, seed):
    """Key 1 holds about half of all rows; a few keys are null."""
    rng = random.Random(seed)
    keys = [1] * 6 + [2, 3, 4, None]
    order = rng.sample(range(10 * n), n)
    return [(o, rng.choice(keys), rng.choice([None, None, rng.randrange(100)])) for o in order]


def carried(data, include_current):
    last, out = {}, {}
    for o, k, v in sorted(data, key=lambda r: r[0]):
        if include_current and v is not None:
            last[k] = v
        out[o] = last.get(k)
        if v is not None:
            last[k] = v
    return out


@pytest.mark.parametrize("blocks", [2, 7, 40])
@pytest.mark.parametrize("include_current", [True, False])
def test_carry_forward(rows, blocks, include_current):
    data = make(300, blocks)
    df = rows(data, "o bigint, k int, v int").repartition(5)
    splits = O.order_splits(df, F.col("o"), blocks)
    got = O.carry_forward(df, ["k"], F.col("o"), [F.col("o")], F.col("v"), "c", include_current, splits)
    assert {r.o: r.c for r in got.collect()} == carried(data, include_current)


def test_previous_row_without_key(rows):
    data = make(200, 5)
    df = rows(data, "o bigint, k int, v int").repartition(5)
    got = O.previous_row(df, [], F.col("o"), [F.col("o")], ["o", "v"], "p", O.order_splits(df, F.col("o"), 9))
    ordered = sorted(data, key=lambda r: r[0])
    expected = {b[0]: (a[0], a[2]) for a, b in zip(ordered, ordered[1:])}
    expected[ordered[0][0]] = None
    assert {r.o: (tuple(r.p) if r.p else None) for r in got.collect()} == expected


def test_rows_without_position_come_first(rows):
    df = rows([(None, 1, 7), (5, 1, None), (900, 1, None)], "o bigint, k int, v int")
    got = O.carry_forward(df, ["k"], F.col("o"), [F.col("o")], F.col("v"), "c", splits=[-1e18, 100.0, 1e18])
    assert {r.o: r.c for r in got.collect()} == {None: 7, 5: 7, 900: 7}


@pytest.mark.parametrize("blocks", [2, 11])
def test_dense_positions(rows, blocks):
    data = make(150, 3)
    df = rows(data, "o bigint, k int, v int")
    got = O.dense_positions(df, "o", "i", O.order_splits(df, F.col("o"), blocks))
    assert [r.i for r in got.orderBy("o").collect()] == list(range(150))


def test_asof_join(rows):
    rng = random.Random(8)
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.randrange(60)) for i in range(80)]
    right = [(i, rng.choice([1, 1, 1, 2, None]), rng.randrange(60)) for i in range(80)]
    ldf, rdf = rows(left, "id bigint, k int, at bigint"), rows(right, "rid bigint, k int, at bigint")
    got = O.asof_join(
        ldf, rdf, ["k"], F.col("at"), F.col("at"), F.struct("rid"), "m", tie=F.col("rid"),
        splits=[float("-inf"), 10.0, 25.0, 40.0, float("inf")],
    )
    expected = {}
    for i, k, at in left:
        before = [(b, rid) for rid, kk, b in right if k is not None and kk == k and b <= at]
        expected[i] = max(before)[1] if before else None
    assert {r.id: (r.m.rid if r.m else None) for r in got.collect()} == expected


def test_latest_within_takes_the_boundary(spark):
    left = spark.sql("SELECT 1 AS id, 7 AS k, TIMESTAMP_NTZ'2024-01-01 00:10:00' AS ts")
    for seconds, hit in (("00:00:00", 9), ("00:00:01", 9)):
        right = spark.sql(f"SELECT 9 AS id, 7 AS k, TIMESTAMP_NTZ'2024-01-01 {seconds}' AS ts")
        found = J.latest_within(left, right, ["k"], "ts", "id", within_s=600).first()
        assert found.matched_id == hit
    right = spark.sql("SELECT 9 AS id, 7 AS k, TIMESTAMP_NTZ'2023-12-31 23:59:59.999999' AS ts")
    found = J.latest_within(left, right, ["k"], "ts", "id", within_s=600).first()
    assert found.matched_id is None and found.matched_delta_us is None


def test_epoch_micros_ignores_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS ts")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(epoch_micros(F.col("ts"))).first()[0] == 1711852200000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_backward_steps(rows):
    df = rows([(1, 5, "a"), (2, 4, "a"), (3, 9, "a"), (1, 1, "b"), (2, 1, "b")], "o bigint, m int, k string")
    got = O.backward_steps(df, ["k"], "o", "m", splits=[float("-inf"), 1.5, float("inf")])
    assert {r.k: (r.n_rows, r.n_backward) for r in got.collect()} == {"a": (3, 1), "b": (2, 0)}


def largest_block(df):
    return max(r["count"] for r in df.groupBy(O.BLOCK).count().collect())


def test_one_instant_is_cut_by_what_follows(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.lit(7).alias("at"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    splits = O.order_splits(rows, F.col("at"), 16, then=F.col("id"))
    assert largest_block(O.with_block(rows, F.col("at"), splits, F.col("id"))) <= 4000 / 16 * 2
    order = [F.col("at"), F.col("id")]
    filled = O.carry_forward(rows, ["k"], F.col("at"), order, F.col("v"), "last", splits=splits, then=F.col("id"))
    assert all(r.last == r.id // 5 * 5 for r in filled.collect())


def test_asof_at_one_instant_and_without_time(spark):
    left = spark.range(900).select("id", F.lit("k").alias("k"), F.when(F.col("id") < 600, F.lit(5)).cast("bigint").alias("at"))
    right = spark.range(500).select(F.lit("k").alias("k"), F.lit(5).cast("bigint").alias("at"), F.col("id").alias("r"))
    at, tie = F.col("at"), F.col("r")
    found = O.asof_join(left, right, ["k"], at, at, F.struct("r"), "m", tie=tie)
    assert [(r.id, r.m and r.m.r) for r in found.orderBy("id").collect()] == [(i, 499 if i < 600 else None) for i in range(900)]
    empty = O.with_block(left, at, [float("-inf"), 0.0, float("inf")], unplaced=F.pmod("id", F.lit(10)))
    assert max(r["count"] for r in empty.where("at IS NULL").groupBy(O.BLOCK).count().collect()) == 30
