"""The gram index stores lists of texts, whatever runs a task cuts them in."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperlode.operators import blocks as B
from paperlode.operators import gram_index as G

TEXTS = [(i, f"ab\U0001f600cd é{i % 3} ab ab") for i in range(90)]
ODD = [(None, "abc abc"), (100, None), (101, "ab"), (102, ""), (7, "abcd ab"), (7, "abcd ab"), (103, "日本語 日本語")]


def test_runs_of():
    assert list(B.runs_of(np.array([3, 3, 9, 0, 1, 2]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(B.runs_of(np.array([], dtype=np.int64), 6)) == []
    assert list(B.runs_of(np.array([0, 0, 50]), 6)) == [(0, 2), (2, 3)]


def windows(text):
    return {text[i : i + 3] for i in range(len(text) - 2)}


def test_a_stored_row_of_the_gram_index_stands_for_many_texts(spark, rows, tmp_path):
    G.write_gram_index(rows(TEXTS + ODD, "id bigint, t string").coalesce(1), "id", "t", str(tmp_path))
    want = Counter(w for i, t in TEXTS + ODD if i is not None and t is not None for w in windows(t))
    assert {r.gram: r.n for r in spark.read.parquet(f"{tmp_path}/grams").collect()} == want
    assert spark.read.parquet(f"{tmp_path}/postings").count() == len(want)


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_lists_of_windows_hold_all_pairs(monkeypatch, limit):
    monkeypatch.setattr(G, "CHUNK", limit)
    texts = [(i, t) for i, t in TEXTS + ODD if t is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], ["id", "t"])
    found = Counter((r["gram"], i) for b in G._lists_by_task(iter([batch])) for r in b.to_pylist() for i in r["ids"])
    assert found == Counter((w, i) for i, t in texts for w in windows(t))
