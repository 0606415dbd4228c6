"""The index for words stores lists of postings, whatever runs a task cuts texts in."""

import re
from collections import Counter

import pyarrow as pa
import pytest

from paperlode.operators import retrieval as R

TEXTS = [(i, f"ab\U0001f600cd é{i % 3} ab ab") for i in range(90)]
ODD = [(None, "abc abc"), (100, None), (101, "ab"), (102, ""), (7, "abcd ab"), (7, "abcd ab"), (103, "日本語 日本語")]


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_lists_of_words_hold_all_pairs(monkeypatch, limit):
    monkeypatch.setattr(R, "CHUNK", limit)
    texts = [(i, t) for i, t in TEXTS + ODD if t is not None]
    words = [re.findall("[a-z0-9]+", t) for _, t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array(words, pa.list_(pa.string()))], ["id", "w"])
    found, n = Counter(), Counter()
    for r in (r for b in R._lists_by_task(iter([batch])) for r in b.to_pylist()):
        found.update((r["term"], *x) for x in zip(r["ids"], r["dls"], r["tfs"]))
        n[r["term"]] += r["n_words"]
    assert found == Counter((w, i, len(ws), c) for (i, _), ws in zip(texts, words) for w, c in Counter(ws).items())
    assert n == Counter(w for ws in words for w in ws)


def test_a_stored_row_of_the_index_stands_for_many_postings(spark, rows, tmp_path):
    df = rows(TEXTS + ODD, "id bigint, t string").coalesce(1)
    R.write_index(df, "id", "t", str(tmp_path))
    terms = {w for _, t in TEXTS + ODD for w in re.findall("[a-z0-9]+", (t or "").lower())}
    assert spark.read.parquet(f"{tmp_path}/postings").count() == len(terms)
    unique = df.where("id <> 7")
    R.write_index(unique, "id", "t", f"{tmp_path}/u")
    assert R.index_top_k(spark, f"{tmp_path}/u", "id", "ab abc 1").collect() == R.bm25_top_k(unique, "id", "t", "ab abc 1").collect()
