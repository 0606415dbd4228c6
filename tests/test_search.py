"""Substring index, distances, dictionary, masking, and limits of nothing, against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from paperlode.functions import text as X
from paperlode.functions.dictionary import Dictionary
from paperlode.functions.hashing import canonical_json
from paperlode.operators import gram_index as G
from paperlode.operators import nearby as N
from paperlode.operators.joins import correlated

R = 6371008.8


def like(text, pattern):
    made = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch(made, text, re.S) is not None


def test_like_by_index(spark, rows, tmp_path):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("abcé日 \n", k=rng.randrange(0, 60)))) for i in range(300)]
    texts += [(400, None), (401, ""), (402, "ab"), (403, "100% sure_thing"), (404, "x" * 50_000 + "needle" + "y" * 50_000)]
    df = rows(texts, "id bigint, t string")
    path = str(tmp_path / "g")
    G.write_gram_index(df, "id", "t", path)
    patterns = ["%abc%", "ab%", "%é日%", "%a_b%", "%ab%ca%", "%needle%", "%abcabcabcabc%", "%", "", "a", "%aéb%b", "%zzz%", "%sure_thing"]
    for pattern in patterns:
        found = {r.id for r in G.search_like(df, path, "id", "t", pattern).collect()}
        assert found == {i for i, t in texts if t is not None and like(t, pattern)}, pattern
    assert [r.id for r in G.search_like(df, path, "id", "t", "%100\\% sure\\_%").collect()] == [403]
    assert G.literal_parts("a\\%b%c_d\\\\") == ["a%b", "c", "d\\"]


def test_an_index_of_no_texts(spark, rows, tmp_path):
    df = rows([], "id bigint, t string")
    G.write_gram_index(df, "id", "t", str(tmp_path / "g"))
    assert G.search_like(df, str(tmp_path / "g"), "id", "t", "%abc%").collect() == []


def haversine(a, b):
    (p, q), (r, s) = ([math.radians(x) for x in z] for z in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1, h)))


def places(seed, n):
    rng = random.Random(seed)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]
    spots += [(90.0, 0.0), (90.0, 135.0), (-90.0, 10.0), (89.99, -170.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.999), (0.001, -179.999), (10.0, 370.0), (10.0, 10.0)]
    return spots + [(50.0 + rng.gauss(0, 0.01), 8.0 + rng.gauss(0, 0.01)) for _ in range(40)]


@pytest.mark.parametrize("metres", [0, 1500, 250_000, 19_000_000])
def test_within_distance(rows, metres):
    a, b = list(enumerate(places(1, 60))), list(enumerate(places(2, 80)))
    odd = [(900, None, 1.0), (901, 91.0, 0.0), (902, float("nan"), 0.0), (903, 0.0, float("inf"))]
    left = rows([(i, *p) for i, p in a] + odd, "l bigint, lat double, lng double")
    right = rows([(i, *p) for i, p in b] + odd, "r bigint, lat double, lng double")
    found = N.within_distance(left, right, "l", "r", ("lat", "lng"), ("lat", "lng"), metres)
    want = {(i, j) for i, p in a for j, q in b if haversine(p, q) <= metres}
    got = {(r.l, r.r): r.metres for r in found.collect()}
    assert set(got) == want
    assert all(d == pytest.approx(haversine(dict(a)[i], dict(b)[j]), abs=1e-3) for (i, j), d in got.items())


def test_near_lines(rows):
    lines = {
        "border": [(0.0, 170.0), (0.0, -170.0)],
        "over the pole": [(80.0, 0.0), (80.0, 180.0)],
        "bent": [(50.0, 8.0), (50.5, 8.5), (50.0, 9.0)],
        "spot": [(10.0, 10.0)],
        "still": [(20.0, 20.0), (20.0, 20.0)],
    }
    points = list(enumerate(places(4, 400) + [(85.0, 0.5), (88.0, 179.0), (0.3, 179.9), (50.3, 8.3), (20.001, 20.0), (50.0, 8.5)]))
    limit = 60_000

    def vector(p):
        a, b = map(math.radians, p)
        return (math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a))

    def walked(path):
        for p, q in zip(path, path[1:] or path):
            u, v = vector(p), vector(q)
            for k in range(2001):
                w = [x + (y - x) * k / 2000 for x, y in zip(u, v)]
                size = math.sqrt(sum(x * x for x in w))
                yield [x / size for x in w]

    def nearest(p, path):
        u = vector(p)
        return min(2 * math.asin(min(1, math.dist(u, w) / 2)) for w in walked(path)) * R

    spots = rows([(i, *p) for i, p in points] + [(9999, None, None)], "p bigint, lat double, lng double")
    made = [(k, v + ([(None, 1.0)] if k == "bent" else [])) for k, v in lines.items()] + [("none", []), ("null", None)]
    paths = rows(made, "line string, path array<struct<lat:double,lng:double>>")
    got = {(r.p, r.line): r.metres for r in N.near_lines(spots, paths, "p", "line", ("lat", "lng"), "path", limit).collect()}
    want = {(i, k): d for i, p in points for k, path in lines.items() if (d := nearest(p, path)) <= limit}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=700) for k in want)


def brute_names(names, text):
    found, at = [], 0
    word = lambda c: c == "_" or c.isalnum()
    while at < len(text):
        fits = [n for n in names if n and text.startswith(n, at)
                and not (word(n[0]) and at and word(text[at - 1]))
                and not (word(n[-1]) and at + len(n) < len(text) and word(text[at + len(n)]))]
        if fits:
            best = max(fits, key=len)
            found.append((at, at + len(best), best))
            at += len(best)
        else:
            at += 1
    return found


def test_names_of_a_small_dictionary(spark, rows, monkeypatch):
    names = ["New", "New York", "New York City", "York City Hall", "é", "日本", "-x-", "a b", "", None, "Ann", "Ann"]
    texts = ["New York City Hall", "New York", "NewYork New  York", "Ann, Anna, _Ann é日本 日本", "q-x-q a b a bc", "", None]
    monkeypatch.setattr("paperlode.functions.dictionary.NAMES_PER_AUTOMATON", 3)  # several automata
    spans = Dictionary(spark, rows([(n,) for n in names], "n string"), "n").spans(F.col("t"))
    for r in rows([(t,) for t in texts], "t string").select("t", spans.alias("s")).collect():
        assert [tuple(x) for x in r.s] == brute_names([n for n in names if n], r.t or "")


def test_names_of_a_large_dictionary(spark):
    names = spark.range(100_000).select(F.concat(F.lit("Person "), F.col("id").cast("string")).alias("n"))
    found = Dictionary(spark, names, "n").spans(F.col("t"))
    texts = spark.range(2000).select("id", F.format_string("Person %d met Person %d and person 5, Person 100001.", F.col("id") * 7, F.col("id") * 50).alias("t"))
    for r in texts.select("id", found.alias("s")).collect():
        assert [x.name for x in r.s] == [f"Person {r.id * 7}", *[f"Person {r.id * 50}"] * (r.id * 50 < 100_000)]
    assert Dictionary(spark, names.limit(0), "n").parts == []


@pytest.mark.parametrize(
    "text, names, masked",
    [
        ("see [[ENTITY-1]] and a@b.co", [], "see [[ENTITY-0]]1]] and [[ENTITY-1]]"),
        ("John of TI, TIM and John_", ["John", "TI"], "[[ENTITY-1]] of [[ENTITY-2]], TIM and John_"),
        ("TI", ["ENTITY", "TI", "1"], "[[ENTITY-1]]"),
        ("Ann Lee, Ann", ["Ann", "Ann Lee"], "[[ENTITY-2]], [[ENTITY-1]]"),
        ("a.b (x) $1 \\Q [y]", ["a.b", "(x)", "$1", "\\Q", "[y]"], "[[ENTITY-1]] [[ENTITY-2]] [[ENTITY-3]] [[ENTITY-4]] [[ENTITY-5]]"),
        ("José joséphine Jos", ["José", "Jos"], "[[ENTITY-1]] joséphine [[ENTITY-2]]"),
        ("nothing here", ["absent", ""], "nothing here"),
        ("", ["x"], ""),
    ],
)
def test_masking_keeps_what_only_looks_like_it(rows, text, names, masked):
    df = rows([(text, names)], "t string, n array<string>")
    df = df.withColumn("e", X.mask_table(F.col("t"), F.col("n"))).withColumn("m", X.mask(F.col("t"), F.col("e")))
    row = df.select("m", X.unmask(F.col("m"), F.col("e")).alias("back")).first()
    assert row.m == masked and row.back == text


@pytest.mark.parametrize("within_s, tolerance", [(0, 0.0), (0, 2.0), (5, 0.0), (5, 2.0)])
def test_correlation_with_limits_of_nothing(rows, within_s, tolerance):
    schema = "id bigint, k string, at timestamp_ntz, v double"
    import datetime

    rng = random.Random(8)
    made = lambda n, first: [(first + i, rng.choice("ab"), datetime.datetime(2024, 1, 1, 0, 0, rng.randrange(12)), float(rng.randrange(6))) for i in range(n)]
    a, b = made(30, 0), made(40, 100)
    got = correlated(rows(a, schema), rows(b, schema).withColumnRenamed("id", "rid"), ["k"], "at", "v", "id", "rid", within_s, tolerance)
    for r in got.collect():
        _, k, at, v = a[r.id]
        near = [(abs(x - at), j) for j, o, x, w in b if o == k and abs((x - at).total_seconds()) <= within_s and abs(w - v) <= tolerance]
        assert (r.n_matches, r.nearest) == (len(near), min(near)[1] if near else None)


def test_json_that_has_no_canonical_form(rows):
    bad = ["9007199254740993", '{"a":1,"a":2}', "NaN", "[Infinity]", '{"x":{"b":1,"b":1}}', "-9007199254740993"]
    good = {"9007199254740992": "9007199254740992", '{"b":1,"a":[]}': '{"a":[],"b":1}', "1e3": "1000", "-0": "0"}
    df = rows([(t,) for t in [*bad, *good]], "t string").select("t", canonical_json(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == dict.fromkeys(bad) | good
