"""Traversal against walks in plain Python."""

import random

import pytest

from paperlode.operators import traversal as T


def walk(parents):
    """node -> (root, depth), or (None, None) on a cycle."""
    out = {}
    for node in parents:
        at, seen = node, {node}
        while (up := parents[at]) is not None and up in parents:
            if up in seen:
                at = None
                break
            seen.add(up)
            at = up
        out[node] = (at, len(seen) - 1) if at is not None else (None, None)
    return out


def found_roots(rows, parents):
    df = rows(list(parents.items()) + [(None, 1)], "n bigint, p bigint")
    got = {r.n: (r.root.n if r.root else None, r.depth) for r in T.roots(df, ["n"], ["p"]).collect()}
    assert got.pop(None) == (None, None)
    return got


@pytest.mark.parametrize("name", ["chain", "hot", "cycles", "random", "one"])
def test_roots(rows, name):
    rng = random.Random(name)
    parents = {
        "chain": {i: i - 1 if i else None for i in range(700)},
        "hot": {i: (None if i == 0 else 0 if i % 3 else i - 1) for i in range(600)},
        "cycles": {0: 1, 1: 2, 2: 0, 3: 2, 4: 3, 5: 5, 6: 5, 7: None, 8: 7, 9: 99, 10: 9},
        "random": {i: rng.choice([None, rng.randrange(300), rng.randrange(400)]) for i in range(300)},
        "one": {4: None},
    }[name]
    assert found_roots(rows, parents) == walk(parents)


def test_roots_of_nothing_and_of_two_columns(rows):
    assert T.roots(rows([], "n bigint, p bigint"), ["n"], ["p"]).collect() == []
    df = rows([("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("b", 2, 1), (None, 3, 2)], "g string, n int, up int")
    found = T.roots(df.selectExpr("*", "'clash' AS node", "'clash' AS row"), ["g", "n"], ["g", "up"])
    got = {(r.g, r.n): (r.root and tuple(r.root), r.depth) for r in found.collect()}
    assert got == {("a", 1): (("a", 1), 0), ("a", 2): (("a", 1), 1), ("a", 3): (("a", 1), 2), ("b", 2): (("b", 2), 0), (None, 3): (None, None)}


def brute_reach(edges, deepest=None):
    out, near = {}, {}
    for s, t in edges:
        if s is not None and t is not None:
            near.setdefault(s, set()).add(t)
    for s in near:
        level, depth, seen = set(near[s]), 1, {}
        while level and (deepest is None or depth <= deepest):
            seen |= {t: depth for t in level if t not in seen}
            level, depth = {u for t in level for u in near.get(t, ())} - set(seen), depth + 1
        out |= {(s, t): d for t, d in seen.items()}
    return out


@pytest.mark.parametrize("deepest", [None, 1, 3, 4])
@pytest.mark.parametrize("name", ["chain", "star", "cycle", "random"])
def test_reach(rows, name, deepest):
    rng = random.Random(name)
    edges = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(0, i) for i in range(1, 60)] + [(i, 100 + i % 2) for i in range(60)] + [(0, 1)] * 30 + [(None, 1), (1, None)],
        "cycle": [(i, (i + 1) % 13) for i in range(13)] + [(5, 5)],
        "random": [(rng.randrange(40), rng.randrange(40)) for _ in range(70)],
    }[name]
    got = T.reach(rows(edges, "a bigint, b bigint"), "a", "b", deepest)
    assert {(r.a, r.b): r.depth for r in got.collect()} == brute_reach(edges, deepest)


def test_reach_of_nothing(rows):
    assert T.reach(rows([], "a bigint, b bigint"), "a", "b").collect() == []
