"""Joins, statistics, names, policies and upkeep on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from paperlode.functions.geo import haversine_m
from paperlode.functions.times import still_valid
from paperlode.functions.vectors import cosine, dot
from paperlode.operators import access as A
from paperlode.operators import jobs as Q
from paperlode.operators import joins as J
from paperlode.operators import similarity as S
from paperlode.operators import stats as ST
from paperlode.operators.once import computed_once


def test_left_join_many_equals_left_join(rows):
    rng = random.Random(4)
    one = rows([(i, f"n{i}") for i in range(20)] + [(None, "null")], "a int, name string")
    many = rows([(rng.choice([3, 3, 3, 5, 7, None]), i) for i in range(60)], "b int, v int")
    got = J.left_join_many(one, many, "a", "b").select("a", "name", "b", "v")
    expected = one.join(many, one.a == many.b, "left").select("a", "name", "b", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_suffix_join(rows):
    uris = rows([("s3://b/x/report.pdf",), ("report.pdf",), ("pdf",), ("s3://b/none.txt",), (None,)], "uri string")
    names = rows([("report.pdf", 1), ("x/report.pdf", 2), ("pdf", 3), ("PDF", 4), (None, 5)], "name string, n int")
    got = sorted((str(r.uri), r.n or 0) for r in J.suffix_join(uris, "uri", names, "name").collect())
    assert got == sorted(
        [("s3://b/x/report.pdf", 1), ("s3://b/x/report.pdf", 2), ("s3://b/x/report.pdf", 3), ("report.pdf", 1),
         ("report.pdf", 3), ("pdf", 3), ("s3://b/none.txt", 0), ("None", 0)]
    )
    assert J.suffix_join(uris, "uri", names.where("n > 9"), "name").count() == 5


def test_missing_references_ignore_null(rows):
    child = rows([(1,), (1,), (2,), (None,)], "k int")
    parent = rows([(2,), (None,)], "p int")
    assert [tuple(r) for r in J.missing_references(child, "k", parent, "p").collect()] == [(1, 2)]


def test_not_listed_follows_sql(rows):
    df = rows([("a", ["a"]), ("b", ["a"]), ("c", ["a", None]), ("d", []), (None, ["a"])], "v string, l array<string>")
    got = [r.ok for r in df.select(J.not_listed(F.col("v"), F.col("l")).alias("ok")).collect()]
    assert got == [False, True, None, True, None]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similarity_join_is_exact(rows, threshold):
    rng = random.Random(6)
    names = {"".join(rng.choices("abc ", k=rng.randrange(1, 9))) for _ in range(70)} | {"!!", "Abc", "abc"}
    df = rows([(n,) for n in names for _ in range(2)], "name string")

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in name.lower().replace("!", " ").split() for i in range(len(w) + 1)}

    expected = {}
    for a in names:
        for b in names:
            if a < b and grams(a) and grams(b):
                score = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
                if round(score, 6) >= threshold:
                    expected[a, b] = round(score, 6)
    got = {(r.left_name, r.right_name): r.similarity for r in S.similarity_join(df, "name", threshold).collect()}
    assert got == expected


def test_sound_and_spelling(rows):
    df = rows([("Ann Robert",), ("Bo Rupert",), ("Bo Rupert",), ("Al Tymczak",)], "name string")
    assert {(r.sound, r.n_names, r.n_rows) for r in S.sound_groups(df, "name").collect()} == {("R163", 2, 3), ("T522", 1, 1)}
    assert {(r.name, r.edits) for r in S.nearest_spellings(df, "name", "Bo Ruport", 2).collect()} == {("Bo Rupert", 1)}


def test_policies_are_joined_by_or(rows):
    df = rows([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, kind string")
    blocked, granted = rows([(1,), (None,)], "id int"), rows([(3,), (3,)], "id int")
    policies = [
        A.Policy(F.col("kind") == "a", forbids=blocked, key="id"),
        A.Policy(F.col("kind") == "b"),
        A.Policy(F.lit(True), requires=granted, key="id"),
    ]
    assert {r.id for r in A.visible_rows(df, policies).collect()} == {2, 3}
    assert A.visible_rows(df, []).count() == 0
    assert A.visible_rows(df, policies).columns == ["id", "kind"]


def test_statistics(rows):
    df = rows([("g", "x", True), ("g", "x", False), ("g", "y", None), ("h", "x", None), ("h", "y", None)], "g string, c string, ok boolean")
    assert {(r.g, r.winner, r.votes) for r in ST.plurality(df, "g", "c").collect()} == {("g", "x", 2), ("h", "tie", 1)}
    assert {(r.g, r.n_checked, r.rate) for r in ST.rate_by(df, "g", F.col("ok")).collect()} == {("g", 2, 0.5), ("h", 0, 0.5)}
    assert [r.g for r in ST.groups_without(df, "g", F.col("ok")).collect()] == ["h"]
    tallies = ST.rule_tallies(df, {"ok": F.col("ok"), "x": F.col("c") == "x"})
    assert {tuple(r) for r in tallies.collect()} == {("ok", 1, 1, 3), ("x", 3, 2, 0)}
    facets = ST.facet_counts(df, {"c": F.col("c"), "ok": F.col("ok")})
    assert {tuple(r) for r in facets.collect()} == {("c", "x", 3), ("c", "y", 2), ("ok", "true", 1), ("ok", "false", 1)}


def test_value_conflicts(rows):
    df = rows(
        [("e", "s1", "1"), ("e", "s2", "1"), ("e", "s2", "2"), ("f", "s1", "1"), ("f", "s2", "2"), ("f", "s3", None)],
        "e string, s string, v string",
    )
    assert [tuple(r) for r in ST.value_conflicts(df, "e", "s", "v").collect()] == [("f", 2, 2)]


def test_upkeep(rows):
    jobs = rows([(1, "low", True, 9), (2, "high", True, 1), (3, "odd", False, 9)], "id int, tier string, stale boolean, n int")
    placed = jobs.withColumn("place", Q.ordinal(F.col("tier"), ["high", "low"]))
    assert [r.id for r in Q.next_jobs(placed, [F.asc_nulls_last("place")], 2).collect()] == [2, 1]
    swept = Q.sweep_stale(jobs, F.col("stale"), F.col("n"), 5, "state")
    assert {r.id: r.state for r in swept.collect()} == {1: "dead", 2: "queued", 3: None}


def test_columns(rows):
    df = rows([([3.0, 4.0], [4.0, 3.0], 48.8566, 2.3522, 51.5074, -0.1278)], "a array<float>, b array<float>, y1 double, x1 double, y2 double, x2 double")
    got = df.select(
        dot(F.col("a"), F.col("b")).alias("dot"),
        cosine(F.col("a"), F.col("b")).alias("cos"),
        haversine_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).alias("m"),
        still_valid(F.lit(None).cast("int"), F.lit(3)).alias("open"),
        still_valid(F.lit(3), F.lit(3)).alias("over"),
    ).first()
    assert got.dot == 24.0 and got.cos == pytest.approx(0.96) and got.m == pytest.approx(343556, rel=1e-3)
    assert got.open is True and got.over is False


def test_computed_once_blocks_pushdown(rows):
    df = computed_once(rows([(1, "ab")], "id int, t string"), ["id"], {"n": F.length("t"), "u": F.upper("t")})
    assert [tuple(r) for r in df.where("n = 2").collect()] == [(1, 2, "AB")]
    assert df.where("n > 5").count() == 0


def test_correlated_by_party_time_and_amount(rows):
    left = rows([(1, 1, 0, 10.0), (2, 1, 3600, 10.0), (3, 2, 0, 10.0), (4, None, 0, 10.0), (5, 1, 0, None)],
                "id int, k int, s int, v double")
    right = rows([(10, 1, 60, 10.5), (11, 1, -60, 9.5), (12, 1, 60, 11.5), (13, 1, 3700, 10.9), (14, 3, 0, 10.0)],
                 "id int, k int, s int, v double")
    both = [d.withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("s")).cast("timestamp_ntz")) for d in (left, right)]
    found = J.correlated(*both, ["k"], "ts", "v", "id", "id", 120, 1.0).collect()
    assert {r.id: (r.n_matches, r.nearest) for r in found} == {1: (2, 10), 2: (1, 13), 3: (0, None), 4: (0, None), 5: (0, None)}
