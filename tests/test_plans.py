"""Shape of physical plans: what must not appear, and what must be shared."""

import re

import pytest

from paperlode.operators import retrieval as R
from paperlode.plans import QUERIES
from paperlode.sources.tables import load_table
from tests.conftest import SMALL

EAGER = {
    "hybrid_search", "hybrid_reranked", "hybrid_in_scope", "streamed_events", "bm25_stored_index", "bm25_stemmed_index", "similar_name_pairs", "file_digests", "json_documents",
    "json_lines", "inclusion_proofs", "sealed_events", "streamed_users", "watermarked_users",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_products(spark, name):
    text = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    # The one nested loop in use joins a global aggregate, i.e. one row.
    for line in re.findall(r"BroadcastNestedLoopJoin.*", text):
        assert "n#" in line and name.startswith(("bm25", "hybrid"))


def test_bm25_reads_texts_once(spark):
    df = R.bm25_top_k(load_table(spark, SMALL, "documents"), "doc_id", "text", "apache license the version of")
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_dense_top_k_passes_on_k_rows_per_task(spark):
    vectors = load_table(spark, SMALL, "embeddings").repartition(3)
    target = R.vector_of(vectors, "vec_id", "embedding", 0)
    df = R.dense_top_k(vectors, "vec_id", "embedding", target, k=5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("MapInPandas")  # what is grouped comes out of the tasks' best
    scored = vectors.select("vec_id", R.cosine_to(R.F.col("embedding"), target).alias("score"))
    local = scored.mapInPandas(R._best_of_task("vec_id", 5), scored.schema)
    assert local.count() <= 3 * 5 < scored.count()


def test_hybrid_search_names_its_rows_to_the_scan(spark):
    text = plan_of(QUERIES["hybrid_reranked"](spark, SMALL))
    assert re.search(r"PushedFilters: \[.*In\(doc_id", text) and text.count("FileScan") == 1


def test_left_chain_reads_each_table_once_per_branch(spark):
    text = plan_of(QUERIES["lineage"](spark, SMALL))
    assert max(text.count(f"{name}.parquet") for name in ("customer", "orders", "lineitem")) <= 3


def test_suffix_matches_once(spark):
    text = plan_of(QUERIES["page_document_links"](spark, SMALL))
    assert text.count("Generate explode") == 1


def test_carry_forward_joins_nothing(spark):
    text = plan_of(QUERIES["carried_purchase"](spark, SMALL))
    assert "Join" not in text
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", text)
    assert windows and all("user_id" in w for w in windows)


def test_columns_are_pruned(spark):
    text = plan_of(QUERIES["lineage"](spark, SMALL))
    assert "l_extendedprice" not in text and "o_totalprice" not in text
    text = plan_of(QUERIES["content_groups"](spark, SMALL))
    assert "n_chars" not in text and "lang" not in text
