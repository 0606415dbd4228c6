"""Retrieval over documents and embeddings.

The tables declare no link between embeddings and documents. Hybrid queries take vec_id = doc_id, and
the vector stored under id 0 plays the embedded query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.operators import retrieval as R
from paperlode.plans.registry import Tables, query
from paperlode.session import shared_dir
from paperlode.sources.tables import version_of

QUERY = "apache license the version of"
PHRASE = "released under the license"


def _terms(text: str) -> str:
    return ", ".join(f"('{t}')" for t in R.query_terms(text))


def _bm25(text: str, k: int, all_terms: bool = False, where: str = "TRUE") -> str:
    need = f"HAVING count(*) = {len(R.query_terms(text))}" if all_terms else ""
    return f"""(
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE {where}),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf
       FROM tok, (VALUES {_terms(text)}) q(term)),
hit AS (SELECT * FROM tf WHERE tf > 0),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
       / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM hit JOIN df USING (term), st GROUP BY doc_id {need}
ORDER BY score DESC, doc_id LIMIT {k})"""


def _dense(target: int, k: int, where: str = "TRUE") -> str:
    return f"""(
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[],
         (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {target})), 6) AS score
FROM embeddings WHERE {where} ORDER BY score DESC, vec_id LIMIT {k})"""


def _hybrid(k: int, rerank: str | None = None, where: str = "TRUE") -> str:
    columns = ", rerank" if rerank else ""
    scored = f", {rerank} AS rerank" if rerank else ""
    first = "rerank DESC, " if rerank else ""
    return f"""
WITH lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical_rank
             FROM {_bm25(QUERY, 50, where=where)}),
den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS dense_rank
        FROM {_dense(0, 50, f"vec_id IN (SELECT doc_id FROM documents WHERE {where})")}),
fused AS (SELECT doc_id, lexical_rank, dense_rank,
            round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 12) AS fused
          FROM lex FULL JOIN den USING (doc_id)
          ORDER BY fused DESC, lexical_rank ASC NULLS LAST, dense_rank ASC NULLS LAST, doc_id LIMIT {k * 4}),
hits AS (SELECT f.*, d.source{scored} FROM fused f JOIN documents d USING (doc_id))
SELECT doc_id, source, fused, lexical_rank, dense_rank{columns} FROM hits
ORDER BY {first}fused DESC, lexical_rank ASC NULLS LAST, dense_rank ASC NULLS LAST, doc_id LIMIT {k}"""


_RERANK = f"""round(len(list_intersect([{", ".join(f"'{t}'" for t in R.query_terms(QUERY))}],
  regexp_extract_all(lower(d.text), '[a-z0-9]+'))) / {len(R.query_terms(QUERY))}.0::DOUBLE, 6)"""


@query(f"SELECT * FROM {_bm25(QUERY, 50)}")
def bm25_top_k(t: Tables) -> DataFrame:
    return R.bm25_top_k(t.documents, "doc_id", "text", QUERY)


@query(f"SELECT * FROM {_bm25(PHRASE, 50, all_terms=True)}")
def bm25_all_terms(t: Tables) -> DataFrame:
    return R.bm25_top_k(t.documents, "doc_id", "text", PHRASE, require_all=True)


_INDEXES: dict[tuple, str] = {}


def stored_index(t: Tables) -> str:
    """The folder of the index over `documents`; built once in a session for each state of the table's files."""
    key = (t.spark.sparkContext.applicationId, version_of(t.documents))
    if key not in _INDEXES:
        path = shared_dir(t.spark, "index")
        R.write_index(t.documents, "doc_id", "text", path)
        _INDEXES[key] = path
    return _INDEXES[key]


@query(f"SELECT * FROM {_bm25(QUERY, 50)}")
def bm25_stored_index(t: Tables) -> DataFrame:
    return R.index_top_k(t.spark, stored_index(t), "doc_id", QUERY)


#: The words that share a stem with a query term, written out, as the SQL engine has no stemmer.
_FORMS = {
    "licens": ["license", "licensed", "licenses", "licensing"],
    "under": ["under"],
    "version": ["version", "versions"],
}


@query(f"""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT doc_id, len(w) AS dl, label, sum(len(list_filter(w, lambda x: x = term))) AS tf
       FROM tok, (VALUES {", ".join(f"('{f}', '{s}')" for s, fs in _FORMS.items() for f in fs)}) q(term, label) GROUP BY ALL),
hit AS (SELECT * FROM tf WHERE tf > 0),
df AS (SELECT label, count(*) AS df FROM hit GROUP BY label)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM hit JOIN df USING (label), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def bm25_stemmed_index(t: Tables) -> DataFrame:
    """Forms of a word count as one term; a test also compares it with texts whose forms are merged by hand."""
    return R.index_top_k(t.spark, stored_index(t), "doc_id", "licensed under versions", stemmed=True)


@query(f"""
SELECT doc_id, lang, source FROM documents
WHERE len(list_intersect(['license', 'released', 'the', 'under'], regexp_extract_all(lower(text), '[a-z0-9]+'))) = 4""")
def full_text_match(t: Tables) -> DataFrame:
    return R.match_all_terms(t.documents, "text", PHRASE).select("doc_id", "lang", "source")


@query("""
SELECT a.term, n_docs, n_occurrences FROM
 (SELECT term, count(*) AS n_occurrences FROM
   (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term) a
JOIN
 (SELECT term, count(*) AS n_docs FROM
   (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) GROUP BY term) b
ON a.term = b.term""")
def term_statistics(t: Tables) -> DataFrame:
    return R.term_statistics(t.documents, "doc_id", "text")


@query("""
SELECT doc_id, term, count(*) AS tf FROM
 (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY doc_id, term""")
def postings(t: Tables) -> DataFrame:
    return R.postings(t.documents, "doc_id", "text").select("doc_id", "term", "tf")


@query(f"SELECT * FROM {_dense(0, 50)}")
def dense_top_k(t: Tables) -> DataFrame:
    target = R.vector_of(t.embeddings, "vec_id", "embedding", 0)
    return R.dense_top_k(t.embeddings, "vec_id", "embedding", target)


@query(f"""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM {_dense(0, 50)}),
b AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM {_dense(1, 50)})
SELECT vec_id, a.r AS first_rank, b.r AS second_rank,
  round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 12) AS fused
FROM a FULL JOIN b USING (vec_id)""")
def rank_fusion(t: Tables) -> DataFrame:
    lists = {}
    for name, target in (("first", 0), ("second", 1)):
        vector = R.vector_of(t.embeddings, "vec_id", "embedding", target)
        top = R.dense_top_k(t.embeddings, "vec_id", "embedding", vector)
        lists[name] = R.ranked(top, "vec_id", "score", "rank")
    return R.fuse_ranks(lists, "vec_id").select("vec_id", "first_rank", "second_rank", "fused")


def _search(t: Tables, **options) -> DataFrame:
    target = R.vector_of(t.embeddings, "vec_id", "embedding", 0)
    return R.hybrid_search(
        t.documents, t.embeddings, "doc_id", "text", "vec_id", "embedding", QUERY, target, **options
    )


@query(_hybrid(20))
def hybrid_search(t: Tables) -> DataFrame:
    return _search(t).select("doc_id", "source", "fused", "lexical_rank", "dense_rank")


@query(_hybrid(20, rerank=_RERANK))
def hybrid_reranked(t: Tables) -> DataFrame:
    found = _search(t, reranker=R.term_overlap(QUERY))
    return found.select("doc_id", "source", "fused", "lexical_rank", "dense_rank", "rerank")


@query(_hybrid(20, where="lang = 'en'"))
def hybrid_in_scope(t: Tables) -> DataFrame:
    found = _search(t, scope=F.col("lang") == "en")
    return found.select("doc_id", "source", "fused", "lexical_rank", "dense_rank")
