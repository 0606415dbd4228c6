"""Digests, chains and trees against hashlib."""

import hashlib
import json
import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlode.functions.hashing import canonical, canonical_json, row_payload
from paperlode.operators import integrity as I


def tree_head(leaves):
    """RFC 6962, section 2.1, by its recursive definition."""
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return hashlib.sha256(b"\x01" + tree_head(leaves[:k]) + tree_head(leaves[k:])).digest()


def leaf_hashes(n):
    return [hashlib.sha256(b"\x00" + f"row {i}".encode()).digest() for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 21])
def test_root_and_every_path(spark, rows, n):
    leaves = leaf_hashes(n)
    df = rows([(10 * i, f"row {i}") for i in range(n)], "o bigint, p string").repartition(3)
    made = I.merkle_leaves(df, "o", F.col("p"))
    head = tree_head(leaves)
    assert I.merkle_root(made, n, fan_in=4).first().root_hash == head.hex()
    levels = I.merkle_levels(made, n, fan_in=4, store=True)
    for i in {0, n // 2, n - 1}:
        path = I.audit_path(levels, i, fan_in=4)
        assert I._climb(leaves[i], i, n, path) == head


def test_every_leaf_of_small_trees():
    for n in range(1, 18):
        leaves = leaf_hashes(n)
        head = tree_head(leaves)
        assert I._root_of(leaves) == head
        for i in range(n):
            path = I._path_in(leaves, i)
            assert I._climb(leaves[i], i, n, path) == head
            assert I._climb(leaves[i], i, n, path + [leaves[0]]) != head
            if path:
                assert I._climb(leaves[i], i, n, path[:-1]) != head


def test_tampering_is_seen(rows):
    leaves = leaf_hashes(7)
    head, path = tree_head(leaves), I._path_in(leaves, 4)
    flipped = bytes([path[0][0] ^ 1]) + path[0][1:]
    data = [
        ("good", leaves[4], 4, 7, path, head),
        ("leaf", leaves[3], 4, 7, path, head),
        ("path", leaves[4], 4, 7, [flipped, *path[1:]], head),
        ("root", leaves[4], 4, 7, path, leaves[0]),
        ("index", leaves[4], 5, 7, path, head),
        ("size", leaves[4], 4, 4, path, head),
    ]
    df = rows(data, "name string, leaf binary, i bigint, n bigint, path array<binary>, root binary")
    ok = I.included(F.col("leaf"), F.col("i"), F.col("n"), F.col("path"), F.col("root"))
    assert {r.name: r.ok for r in df.select("name", ok.alias("ok")).collect()} == {
        "good": True, "leaf": False, "path": False, "root": False, "index": False, "size": False,
    }


def chain(payloads):
    prev, out = I.GENESIS, []
    for i, p in enumerate(payloads):
        h = hashlib.sha256((prev + p).encode()).hexdigest()
        out.append([i, p, prev, h])
        prev = h
    return out


def test_cumulative_chain(rows):
    schema = "i bigint, p string, prev_hash string, hash string"
    good = chain([f"entry {i}" for i in range(40)])
    split = [float("-inf"), 9.5, 20.0, float("inf")]

    def broken(log):
        checked = I.verify_chain(rows(log, schema).repartition(3), "i", F.col("p"), split)
        return {r.i for r in checked.collect() if not (r.content_ok and r.pointer_ok)}

    assert broken(good) == set()
    changed = [list(r) for r in good]
    changed[10][1] = "forged"
    assert broken(changed) == {10}
    assert broken(good[:20] + good[21:]) == {21}
    assert broken(good[1:]) == {1}


def test_links_point_to_the_row_before(rows):
    df = rows([(i, f"p{i}") for i in range(12)], "i bigint, p string").repartition(4)
    linked = I.link_rows(df, "i", F.col("p"), [float("-inf"), 5.0, float("inf")]).orderBy("i").collect()
    assert linked[0].prev_hash == I.GENESIS
    assert all(b.prev_hash == a.row_hash for a, b in zip(linked, linked[1:]))


def test_new_content_is_repeatable(spark, rows):
    stored = rows([(1, "a"), (2, "b")], "id bigint, text string")
    incoming = rows([(7, "b"), (9, "c"), (8, "c"), (6, None)], "id bigint, text string")
    fresh = I.new_content(incoming, stored, "id", F.col("text"))
    got = {(r.first_id, r.n_copies) for r in fresh.where("content_hash IS NOT NULL").collect()}
    assert got == {(8, 2)}
    grown = stored.unionByName(incoming)
    assert I.new_content(incoming, grown, "id", F.col("text")).where("content_hash IS NOT NULL").count() == 0


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"),
        (1e-6, "0.000001"), (1e-7, "1e-7"), (123456.789, "123456.789"), (5e-324, "5e-324"),
        (1.7976931348623157e308, "1.7976931348623157e+308"), (333333333.33333329, "333333333.3333333"),
        (9007199254740993, "9007199254740992"), (0.1, "0.1"), (4.50, "4.5"), (2e-3, "0.002"), (1e23, "1e+23"),
    ],
)
def test_canonical_numbers(value, text):
    assert canonical(value) == text


@settings(max_examples=300, deadline=None)
@given(st.integers(min_value=0, max_value=2**64 - 1))
def test_canonical_numbers_read_back(bits):
    value = struct.unpack("<d", struct.pack("<Q", bits))[0]
    if math.isfinite(value):
        assert float(canonical(value)) == value


def test_canonical_json(rows):
    df = rows(
        [(1, '{"b": [1.0, {"z": null, "a": "é"}], "a": true}'), (2, "not json"), (3, None), (4, '{"\\ud83d\\ude00":1,"\\uffff":2}')],
        "i int, raw string",
    )
    got = {r.i: r.c for r in df.select("i", canonical_json(F.col("raw")).alias("c")).collect()}
    assert got[1] == '{"a":true,"b":[1,{"a":"é","z":null}]}'
    assert got[2] is None and got[3] is None
    assert list(json.loads(got[4])) == ["\U0001f600", "￿"]


def test_moved_text_changes_the_payload(rows):
    df = rows([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "-"), ("", "a"), (None, "a"), ("1:a", "")], "x string, y string")
    payloads = [r[0] for r in df.select(row_payload(F.col("x"), F.col("y"))).collect()]
    assert len(set(payloads)) == len(payloads)


def test_erased_hashes_fail(rows):
    log = I.link_rows(rows([(i, f"p{i}") for i in range(9)], "i bigint, p string"), "i", F.col("p"))
    kept = log.withColumn("row_hash", F.when(F.col("i") != 3, F.col("row_hash")))
    kept = kept.withColumn("link_hash", F.when(~F.col("i").isin(3, 6), F.col("link_hash")))
    found = {r.i: (r.content_ok, r.link_ok, r.pointer_ok) for r in I.verify_links(kept, "i", F.col("p")).collect()}
    assert found[3] == (False, False, True) and found[4] == (True, True, False) and found[6] == (True, False, True)
    assert all(found[i] == (True, True, True) for i in (0, 1, 2, 5, 7, 8))


def test_seal_finds_a_cut_tail(rows):
    df = rows([(i, f"p{i}") for i in range(20)], "i bigint, p string")
    sealed = I.seal(df, "i", F.col("p"))
    whole = I.matches_seal(df, "i", F.col("p"), sealed).first()
    cut = I.matches_seal(df.where("i < 19"), "i", F.col("p"), sealed).first()
    assert (whole.size_ok, whole.root_ok) == (True, True) and (cut.size_ok, cut.root_ok) == (False, False)
    none = I.seal(df.where("i < 0"), "i", F.col("p")).first()
    assert (none.n_rows, none.root_hash) == (0, None)


def test_canonical_json_never_ends_the_job(rows):
    texts = ["9" * 400, '"\\ud800"', "[" * 5000 + "]" * 5000, '{"b":1.50,"a":[1e2,{"d":null,"c":true}]}', "{", None, "1e999"]
    df = rows([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", canonical_json(F.col("t")).alias("c")).collect()}
    assert got[3] == '{"a":[100,{"c":true,"d":null}],"b":1.5}'
    assert got[0] is None and got[1] is None and got[4] is None and got[5] is None and got[6] is None
    assert got[2] in (None, texts[2])
