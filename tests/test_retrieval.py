"""Ranking operators against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from paperlode.operators import retrieval as R

WORDS = ["alpha", "beta", "gamma", "delta", "Eps-ilon", "of", "the"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    data = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 25)))) for i in range(60)] + [(60, None), (61, "")]
    return data, spark.createDataFrame(data, "id bigint, text string").repartition(5)


def cut(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def bm25(data, query, need_all=False):
    terms = sorted(set(cut(query)))
    docs = {i: cut(t) for i, t in data}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    out = {}
    for i, words in docs.items():
        hit = [t for t in terms if t in words]
        if not hit or (need_all and len(hit) < len(terms)):
            continue
        score = 0.0
        for t in hit:
            tf, idf = words.count(t), math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avgdl))
        out[i] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("query", ["alpha", "Gamma delta gamma!", "epsilon eps ilon", "absent", "alpha absent"])
@pytest.mark.parametrize("need_all", [False, True])
def test_bm25(corpus, query, need_all):
    data, df = corpus
    got = [(r.id, r.score) for r in R.bm25_top_k(df, "id", "text", query, 10, need_all).collect()]
    expected = bm25(data, query, need_all)[:10]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], abs=2e-6)


def test_empty_query_finds_nothing(corpus):
    _, df = corpus
    assert R.bm25_top_k(df, "id", "text", " ?! ").count() == 0
    assert R.match_all_terms(df, "text", "").count() == 0


def test_match_needs_whole_words(rows):
    df = rows([(1, "an alphabet"), (2, "Alpha, beta"), (3, "beta"), (4, None)], "id bigint, text string")
    assert [r.id for r in R.match_all_terms(df, "text", "alpha beta").collect()] == [2]


def test_stored_index_ranks_like_the_scan(spark, corpus, tmp_path):
    _, df = corpus
    R.write_index(df, "id", "text", str(tmp_path / "index"), buckets=3)
    for query in ("gamma delta", "the of alpha", "absent"):
        scan = R.bm25_top_k(df, "id", "text", query).collect()
        assert R.index_top_k(spark, str(tmp_path / "index"), "id", query).collect() == scan


def test_stemmed_index_counts_forms_as_one_term(spark, rows, tmp_path):
    forms = [(1, "license terms"), (2, "licensed licenses"), (3, "licensing"), (4, "lichen"), (5, "none of it")]
    path, plain = str(tmp_path / "forms"), str(tmp_path / "plain")
    R.write_index(rows(forms, "id bigint, text string"), "id", "text", path, buckets=4)
    merged = [(i, t.replace("licensed", "license").replace("licenses", "license").replace("licensing", "license")) for i, t in forms]
    R.write_index(rows(merged, "id bigint, text string"), "id", "text", plain, buckets=4)
    found = R.index_top_k(spark, path, "id", "licenses", stemmed=True).collect()
    assert found == R.index_top_k(spark, plain, "id", "license").collect()
    assert {r.id for r in found} == {1, 2, 3}
    assert R.index_top_k(spark, path, "id", "licensing of", stop_words=["OF"]).collect()[0].id == 3


def test_stop_words_leave_the_query(corpus):
    _, df = corpus
    assert R.query_terms("The alpha OF", ["the", "of"]) == ["alpha"]
    with_stops = R.bm25_top_k(df, "id", "text", "the alpha of", stop_words=["the", "of"]).collect()
    assert with_stops == R.bm25_top_k(df, "id", "text", "alpha").collect()


def cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else None


def test_dense_ignores_unusable_vectors_and_repeats(rows):
    rng = random.Random(2)
    query = [0.3, -1.0, 2.0]
    data = [(i % 30, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(45)]
    odd = [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0]), (103, [])]
    df = rows(data + odd, "id bigint, v array<float>")
    best = {}
    for i, v in data:
        best[i] = max(best.get(i, -2), round(cosine(v, query), 6))
    expected = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:12]
    got = R.dense_top_k(df, "id", "v", query, 12).collect()
    assert [r.score for r in got] == pytest.approx([s for _, s in expected], abs=2e-6)
    assert len({r.id for r in got}) == 12
    scope = rows([(3,), (4,), (101,)], "id bigint")
    assert {r.id for r in R.dense_top_k(df, "id", "v", query, 12, scope).collect()} == {3, 4}


def fuse(lists, k):
    score = {}
    for ids in lists:
        for rank, i in enumerate(ids, 1):
            score[i] = score.get(i, 0) + 1 / (k + rank)
    return {i: round(s, 12) for i, s in score.items()}


@pytest.mark.parametrize("k", [10, 60, 1000])
@pytest.mark.parametrize("lists", [([1, 2, 3], [3, 2, 9]), ([1, 2], [3, 4]), ([], [5]), ([], [])])
def test_fusion(rows, lists, k):
    frames = {n: rows([(i, r) for r, i in enumerate(ids, 1)], "id bigint, rank int") for n, ids in zip("ab", lists)}
    got = R.fuse_ranks(frames, "id", k)
    assert {r.id: r.fused for r in got.collect()} == fuse(lists, k)
    order = [r.id for r in got.orderBy(*R.fused_order(["a", "b"], "id")).collect()]
    place = lambda i, ids: ids.index(i) if i in ids else 99
    assert order == sorted(fuse(lists, k), key=lambda i: (-fuse(lists, k)[i], place(i, lists[0]), place(i, lists[1])))


def test_hybrid_scope_and_rerank(rows):
    docs = rows(
        [(1, "red fox", "x"), (2, "red red", "x"), (3, "blue fox", "y"), (4, "green", "y"), (5, "red fox den", "x")],
        "id bigint, text string, scope string",
    )
    vectors = rows([(4, [1.0, 0.0]), (3, [0.9, 0.1]), (1, [0.0, 1.0]), (77, [1.0, 0.0])], "vid bigint, v array<float>")
    args = (docs, vectors, "id", "text", "vid", "v", "red fox", [1.0, 0.0])
    plain = R.hybrid_search(*args, k=10).collect()
    assert {r.id for r in plain} == {1, 2, 3, 4, 5}
    assert {r.id for r in R.hybrid_search(*args, k=10, scope=F.col("scope") == "y").collect()} == {3, 4}
    reranked = R.hybrid_search(*args, k=2, reranker=R.term_overlap("red fox")).collect()
    assert [r.id for r in reranked] == [1, 5] and [r.rerank for r in reranked] == [1.0, 1.0]
