"""Search in the stored vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.operators import vector_index as V
from paperlode.plans.registry import Tables, query
from paperlode.session import shared_dir
from paperlode.sources.tables import version_of

K = 10
#: Queries that measure how many cells have to be probed.
MEASURED = 200
_PATHS: dict[tuple, str] = {}


def vector_index(t: Tables) -> str:
    """The folder of the index over `embeddings`; built once in a session for each state of the table's files."""
    key = (t.spark.sparkContext.applicationId, version_of(t.embeddings))
    if key not in _PATHS:
        path = shared_dir(t.spark, "vector-index")
        V.write_vector_index(t.embeddings, "vec_id", "embedding", path)
        _PATHS[key] = path
    return _PATHS[key]


def _queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
           FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {K}""")
def vector_index_all_cells(t: Tables) -> DataFrame:
    """Every twentieth vector against the index, all cells probed: the exact ranking."""
    return V.search_vector_index(_queries(t), vector_index(t), "query_id", "asked", K).drop("probe")


@query()
def vector_index_probed(t: Tables) -> DataFrame:
    """The same with as many cells as nine in ten of the neighbours need; tests measure the recall by brute force."""
    path, asked = vector_index(t), _queries(t)
    few = asked.orderBy(F.xxhash64("query_id")).limit(MEASURED)
    probes = V.probes_for(few, path, "query_id", "asked", K, recall=0.92)
    return V.search_vector_index(asked, path, "query_id", "asked", K, probes)


@query()
def vector_index_recall(t: Tables) -> DataFrame:
    """Recall for each number of probed cells, over all queries."""
    return V.recall_by_probes(_queries(t), vector_index(t), "query_id", "asked", K)
