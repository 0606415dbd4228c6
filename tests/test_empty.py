"""Operators on tables without rows."""

from pyspark.sql import functions as F

from paperlode.operators import documents as D
from paperlode.operators import integrity as I
from paperlode.operators import joins as J
from paperlode.operators import ordered as O
from paperlode.operators import retrieval as R
from paperlode.operators import similarity as S
from paperlode.operators import stats as ST


def test_ordered(rows):
    df = rows([], "k int, o bigint, v int")
    assert O.carry_forward(df, ["k"], F.col("o"), [F.col("o")], F.col("v"), "c").count() == 0
    assert O.dense_positions(df, "o", "i").count() == 0
    assert O.backward_steps(df, ["k"], "o", "v").count() == 0
    assert O.asof_join(df, df, ["k"], F.col("o"), F.col("o"), F.struct("v"), "m").count() == 0


def test_integrity(rows):
    df = rows([], "o bigint, p string")
    assert I.merkle_root(I.merkle_leaves(df, "o", F.col("p")), 0).count() == 0
    assert I.verify_links(I.link_rows(df, "o", F.col("p")), "o", F.col("p")).count() == 0
    assert I.new_content(df, df, "o", F.col("p")).count() == 0


def test_retrieval(spark, rows, tmp_path):
    docs, vectors = rows([], "id bigint, text string"), rows([], "vid bigint, v array<float>")
    assert R.bm25_top_k(docs, "id", "text", "a b").count() == 0
    assert R.dense_top_k(vectors, "vid", "v", [1.0]).count() == 0
    assert R.hybrid_search(docs, vectors, "id", "text", "vid", "v", "a", [1.0]).count() == 0
    R.write_index(docs, "id", "text", str(tmp_path / "i"))
    assert R.index_top_k(spark, str(tmp_path / "i"), "id", "a").count() == 0


def test_rest(rows):
    df = rows([], "id bigint, text string")
    assert D.byte_chunks(df, "id", "text").count() == 0
    assert D.html_sections(df, "id", "text").count() == 0
    assert J.suffix_join(df, "text", df.select(F.col("text").alias("n")), "n").count() == 0
    assert J.left_join_many(df, df.toDF("b", "t"), "id", "b").count() == 0
    assert S.similarity_join(df, "text", 0.5).count() == 0
    assert ST.plurality(df, "id", "text").count() == 0
    assert ST.row_counts({"t": df}).first().n_rows == 0
