"""Exact search (11), hard negatives (12) and the Merkle manifest (13) against brute force, with odd rows among them."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlode.llm import hard_negatives, knn_join, merkle_manifest
from paperlode.llm import vectors as V

SCHEMA = "vec_id bigint, embedding array<double>, label int"
#: Names that the operators use inside themselves.
CLASH = "row id v cell dist near away asks gang part block score rank other bound windows place group leaf n pos".split()


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).select("*", *[F.lit("clash").alias(c) for c in CLASH])


def whole(x):
    if x is None or any(c is None or not math.isfinite(256 * c) for c in x):
        return None
    return [math.floor(256 * c) for c in x]


def product(a, b):
    return max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def clusters(seed, n, dim=6, centres=12, spread=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def odd_rows():
    """Clusters, a vector that a third of all rows share, repeated ids, and rows that take no part or are short."""
    rows = [(i, list(map(float, x)), i % 4) for i, x in enumerate(clusters(1, 220))]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(130)]
    rows += [(10, rows[3][1], 2), (10, rows[10][1], rows[10][2]), (20, rows[20][1], 0)]
    rows += [(None, rows[1][1], 1), (30, None, 1), (40, [1.0, None], 1), (50, [math.nan] * 6, 1), (60, [math.inf, 1.0], 1)]
    rows += [(70, [], 0), (80, [0.5], 0), (90, [0.0] * 6, 0), (100, [-1.0] * 6, 1), (110, [0.3] * 6, None), (120, [1e308] * 6, 1)]
    return rows


def brute_top(rows, asks, k):
    known = [(i, w) for i, x, _ in rows if i is not None and (w := whole(x)) is not None]
    out = []
    for at, (i, q) in enumerate(known):
        if asks(i):
            best = sorted((-product(q, x), j) for b, (j, x) in enumerate(known) if b != at)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [None, 1, 40])
def test_top_k(spark, pivots):
    rows = odd_rows()
    found = knn_join.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=5, pivots=pivots)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_top_k_of_few_and_of_large_numbers(spark):
    rows = [(1, [3e30, 1.0], 0), (2, [2e30, -1.0], 0), (3, [5e9, 7e9], 0), (4, [-5e9, 7e9], 0)]
    found = knn_join.top_k(table(spark, rows), F.lit(True), k=5)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, lambda i: True, 5)
    assert knn_join.top_k(table(spark, []), F.lit(True)).collect() == []
    assert knn_join.top_k(table(spark, rows[:1]), F.lit(True)).collect() == []


def test_vectors_are_sent_only_where_they_can_matter(spark):
    rows = [(i, list(map(float, x)), 0) for i, x in enumerate(clusters(2, 3000, spread=0.005))]
    df = spark.createDataFrame(rows, SCHEMA)
    space = V.measured(df, "vec_id", "embedding")
    points = V.sample(df, "vec_id", "embedding", 200, space)
    points = points[V.far_apart(points, 12, space)]
    known = knn_join.Summary(knn_join.assigned(df, F.col("vec_id") % 7 == 0, points, space, "vec_id", "embedding").cache(), points, space, 5)
    bound = known.bounds(known.reach[:, None] + known.apart)
    kept = known.most[None] >= known.apart - (known.reach + bound)[:, None]
    sent = (kept * known.count[None]).sum(axis=1)
    assert sent.mean() < 0.8 * len(rows)


def test_queries_of_a_large_cell_are_cut():
    deal = V.dealt(np.array([3, 50_000, 4, 5]), np.array([10, 400_000, 10, 10]), np.ones((4, 4), dtype=bool), 8)
    assert list(deal.gang) == [0, 1, 2, 2] and list(deal.parts) == [1, 7, 1] and (deal.blocks == 25).all()


def brute_negatives(rows, asks, positives=5, negatives=5):
    known = [(i, w, label) for i, x, label in rows if i is not None and label is not None and (w := whole(x)) is not None]
    out = []
    for at, (i, q, label) in enumerate(known):
        if asks(i):
            every = [(-product(q, x), j, other) for b, (j, x, other) in enumerate(known) if b != at]
            for s, j, _ in sorted(e for e in every if e[2] == label)[:positives]:
                inside = sorted((t, n) for t, n, other in every if other != label and 80 * -s <= 100 * -t <= 100 * -s)
                out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("leaf_rows", [2, 8, 1000])
def test_hard_negatives(spark, leaf_rows):
    rows = odd_rows()
    found = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), leaf_rows=leaf_rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(1, [1.0], 1)], [(1, [1.0], None), (2, None, 1)]):
        assert hard_negatives.hard_negatives(table(spark, rows), F.lit(True), F.col("label")).collect() == []


def test_tree_leaves_out_subtrees_and_never_a_member(spark):
    points = clusters(3, 1500, spread=0.01)
    rows = [(i, list(map(float, x)), 0) for i, x in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA)
    space = V.measured(df, "vec_id", "embedding")
    tree = hard_negatives.Tree(V.sample(df, "vec_id", "embedding", 500, space), space, 8)
    tree.measure(hard_negatives.placed(df, F.lit(True), F.col("label"), tree, "vec_id", "embedding"))
    x = np.floor(256 * points)
    q, leaf = x[:60], tree.leaf_of(x)
    score = V.scores(q, x, space)
    own = np.einsum("ij,ij->i", q, q)
    top = np.sort(score, axis=1)
    for high, low in ((top[:, -3], top[:, -40]), (top[:, 700], top[:, 650])):
        alive = tree.alive(q, V.as_distance(high, own, space), V.as_distance(low, own, space))
        members = (score <= high[:, None]) & (score >= low[:, None])
        assert alive[np.nonzero(members)[0], leaf[np.nonzero(members)[1]]].all()
        assert alive.mean() < 0.7


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest("".join(map(enc, (*r[:4], text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: tree([leaf(r, r[4]) for r in by[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(by[s]):
            node, proof = trees[s][0][i], ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf(r, None if r[4] is None else r[4].encode().lower().decode())
            for levels, at in ((trees[s], i), (top, j)):
                for level in levels[:-1]:
                    first = at // 16 * 16
                    before, after = "".join(level[first:at]), "".join(level[at + 1 : first + 16])
                    proof, node, at = proof + before + after, digest(before + node + after), at // 16
            root = top[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, digest(proof), node, node == root))
    return sorted(out, key=str)


def manifest_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    found = merkle_manifest.manifest(df.select("*", *[F.lit("clash").alias(c) for c in CLASH]))
    return sorted((tuple(r)[:7] for r in found.collect()), key=str)


def test_manifest(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"Text Number {i}") for i in range(900)]
    rows += [(5, "hot", "en", 1, "Again"), (5, "hot", "en", 1, "Again"), (5, "hot", None, None, None), (None, "hot", "en", 2, "No Id")]
    rows += [(-7, None, "de", 0, ""), (2000, None, None, None, None), (2001, "", "fr", 3, "É日本😀 A\x00B"), (2002, "zz-é", "fr", 9, "Xy" * 200_000)]
    assert manifest_of(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 4096, 4097])
def test_manifest_of_sizes_at_the_edges_of_levels(spark, n):
    rows = [(i, "s", "en", 1, "Ab") for i in range(n)]
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_versions_copy_only_the_path(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "Ab") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    for r in merkle_manifest.manifest(df).collect():
        chosen = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert (r.version is not None) == chosen
        # 200 leaves a source are two levels, and three sources are one more
        assert not chosen or (len(r.version) == 4 and r.version[-1] == r.folded_root and not r.verified)
