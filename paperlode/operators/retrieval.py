"""Lexical and vector retrieval, rank fusion, reranking, and the index for repeated queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperlode.functions.stemming import stem, stem_word
from paperlode.functions.text import WORD, tokens
from paperlode.functions.vectors import cosine_to
from paperlode.operators.blocks import runs_of
from paperlode.operators.once import computed_once

# Okapi BM25 and reciprocal-rank constants as published.
K1 = 1.2
B = 0.75
RRF_K = 60
# Scores are compared after rounding, so that summation order cannot swap two equal ones.
SCORE_DIGITS = 6
#: Words that a task of the index build holds at once, unless a single text has more.
CHUNK = 1 << 20


def query_terms(query: str, stop_words: Sequence[str] = ()) -> list[str]:
    """Distinct terms of a query, cut like `tokens` cuts a text, without stop words.

    `pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords(language)` has lists to pass.
    """
    return sorted(set(re.findall(WORD, query.lower())) - {w.lower() for w in stop_words})


def match_all_terms(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds every query term as a whole word; a query without terms matches nothing."""
    terms = query_terms(query)
    if not terms:
        return df.where(F.lit(False))
    words = tokens(F.col(text))
    # A substring test is far cheaper than cutting words and rules out most rows before it.
    lowered = F.lower(F.col(text))
    condition = F.lit(True)
    for term in terms:
        condition = condition & F.contains(lowered, F.lit(term))
    return df.where(condition).where(F.size(F.array_except(F.array(*map(F.lit, terms)), words)) == 0)


def term_counts(df: DataFrame, row_id: str, text: str, terms: Sequence[str]) -> DataFrame:
    """(id, dl, tf_0, tf_1, ...): text length in words and frequency of each given term, without a shuffle."""
    cut = df.select(F.col(row_id), tokens(F.col(text)).alias("words"))
    hits = F.filter("words", lambda w: w.isin(*terms))
    kept = computed_once(cut, [row_id], {"dl": _count("words"), "hits": hits})

    def frequency(term: str) -> Column:
        return _count(F.filter("hits", lambda w: w == term))

    return kept.select(row_id, "dl", *[frequency(t).alias(f"tf_{i}") for i, t in enumerate(terms)])


def _count(array: str | Column) -> Column:
    """Size that is never null, so that no null check tells two uses of one exchange apart."""
    return F.coalesce(F.size(array), F.lit(0))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _bm25_part(tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_scores(
    df: DataFrame, row_id: str, text: str, query: str, require_all: bool = False, stop_words: Sequence[str] = ()
) -> DataFrame:
    """(id, score) of each row with at least one query term (with all of them if `require_all`).

    Texts are read and cut once. Their counts (a few numbers per row) go through one exchange that feeds both
    the collection statistics and the scores.
    """
    terms = query_terms(query, stop_words)
    if not terms:
        return df.select(F.col(row_id), F.lit(0.0).alias("score")).where(F.lit(False))
    counts = term_counts(df, row_id, text, terms).repartition(F.col(row_id))
    present = [F.col(f"tf_{i}") > 0 for i in range(len(terms))]
    stats = counts.agg(
        F.count("*").alias("n"),
        F.avg("dl").alias("avgdl"),
        *[F.count_if(p).alias(f"df_{i}") for i, p in enumerate(present)],
    )
    n_present = sum((p.cast("int") for p in present), F.lit(0))
    needed = len(terms) if require_all else 1
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _bm25_part(F.col(f"tf_{i}"), F.col("dl"), F.col("avgdl"), _idf(F.col("n"), F.col(f"df_{i}")))
    # `stats` is a global aggregate, hence exactly one row.
    return (
        counts.join(F.broadcast(stats))
        .where(n_present * F.signum("n") >= needed)
        .select(row_id, F.round(score, SCORE_DIGITS).alias("score"))
    )


def top_k(scored: DataFrame, row_id: str, score: str, k: int) -> DataFrame:
    """The k best rows, ties by id (a per-task heap, then a merge; never a full sort)."""
    return scored.orderBy(F.desc(score), row_id).limit(k)


def ranked(top: DataFrame, row_id: str, score: str, rank: str) -> DataFrame:
    """Number the rows of a top-k result, which `limit` has bounded before this window runs."""
    return top.withColumn(rank, F.row_number().over(W.orderBy(F.desc(score), row_id)))


def bm25_top_k(
    df: DataFrame,
    row_id: str,
    text: str,
    query: str,
    k: int = 50,
    require_all: bool = False,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    return top_k(bm25_scores(df, row_id, text, query, require_all, stop_words), row_id, "score", k)


def dense_top_k(
    df: DataFrame, row_id: str, vector: str, query: Sequence[float], k: int = 50, scope: DataFrame | None = None
) -> DataFrame:
    """Exact cosine ranking of all vectors, or of those whose id is in `scope`.

    With several vectors per id the best one counts, so no id appears twice. Vectors are scored where
    they are read, and each task passes on its k best ids only: an id of the overall best k is among the best k
    of the task that holds its best vector.
    """
    scored = df.select(F.col(row_id), F.round(cosine_to(F.col(vector), query), SCORE_DIGITS).alias("score"))
    if scope is not None:
        scored = scored.join(scope, row_id, "left_semi")
    local = scored.where("score IS NOT NULL").mapInPandas(_best_of_task(row_id, k), scored.schema)
    best = local.groupBy(row_id).agg(F.max("score").alias("score"))
    return top_k(best, row_id, "score", k)


def _best_of_task(row_id: str, k: int) -> Callable:
    """The k best distinct ids of a task, holding k rows and one batch at a time."""

    def run(batches):
        best = None
        for batch in batches:
            both = batch if best is None else pd.concat([best, batch])
            both = both.sort_values(["score", row_id], ascending=[False, True], kind="stable")
            best = both.drop_duplicates(row_id).head(k)
        if best is not None:
            yield best

    return run


def vector_of(df: DataFrame, row_id: str, vector: str, wanted: int) -> list[float]:
    """One stored vector, to be used as a query."""
    row = df.where(F.col(row_id) == wanted).select(vector).first()
    if row is None:
        raise LookupError(f"no vector with {row_id} = {wanted}")
    return list(row[0])


def fuse_ranks(lists: dict[str, DataFrame], row_id: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, each with columns (id, rank).

    Returns (id, fused, <name>_rank ...); an id absent from a list gets nothing from it.
    """
    names = list(lists)
    marked = [df.select(F.col(row_id), F.lit(name).alias("list"), F.col("rank")) for name, df in lists.items()]
    merged = marked[0]
    for more in marked[1:]:
        merged = merged.unionByName(more)
    ranks = [F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in names]
    fused = F.round(F.sum(1.0 / (k + F.col("rank"))), 12)
    return merged.groupBy(row_id).agg(fused.alias("fused"), *ranks)


def fused_order(names: Sequence[str], row_id: str) -> list[Column]:
    """Best fused score first; ties by rank in the first list, then in the next, then by id."""
    return [F.desc("fused"), *[F.asc_nulls_last(f"{n}_rank") for n in names], F.asc(row_id)]


def term_overlap(query: str) -> Callable[[Column], Column]:
    """A deterministic reranker: share of the query's terms that the text holds."""
    terms = query_terms(query)

    def score(text: Column) -> Column:
        if not terms:
            return F.lit(0.0)
        return F.size(F.array_intersect(F.array(*map(F.lit, terms)), tokens(text))) / len(terms)

    return score


def hybrid_search(
    documents: DataFrame,
    vectors: DataFrame,
    row_id: str,
    text: str,
    vector_id: str,
    vector: str,
    query: str,
    query_vector: Sequence[float],
    k: int = 20,
    depth: int = 50,
    over_fetch: int = 4,
    reranker: Callable[[Column], Column] | None = None,
    scope: Column | None = None,
) -> DataFrame:
    """Lexical and dense candidates, fused by rank, joined to their text, optionally reranked, cut to k.

    `scope` restricts the documents of both legs. A vector without a document in scope cannot be a result.
    """
    spark = documents.sparkSession
    if scope is not None:
        documents = documents.where(scope)
    lexical = ranked(bm25_top_k(documents, row_id, text, query, depth), row_id, "score", "rank")
    named = vectors.withColumnRenamed(vector_id, row_id)
    best = dense_top_k(named, row_id, vector, query_vector, depth, scope=documents.select(row_id))
    dense = ranked(best, row_id, "score", "rank")
    order = fused_order(["lexical", "dense"], row_id)
    fused = fuse_ranks({"lexical": lexical, "dense": dense}, row_id).orderBy(*order).limit(k * over_fetch)
    # `fused` holds at most k * over_fetch rows by its limit. They go to the scan as literals, so that files and row
    # groups without these ids are not read for their texts.
    few = fused.collect()
    named = spark.createDataFrame(few, fused.schema)
    hits = documents.where(F.col(row_id).isin([r[row_id] for r in few])).join(F.broadcast(named), row_id)
    if reranker is not None:
        hits = hits.withColumn("rerank", F.round(reranker(F.col(text)), SCORE_DIGITS))
        order = [F.desc("rerank"), *order]
    return hits.orderBy(*order).limit(k)


# --- index for repeated queries -------------------------------------------------------------


def postings(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, dl, term, tf): how often each word occurs in each text, beside the text's length in words."""
    cut = df.select(F.col(row_id), tokens(F.col(text)).alias("words"))
    once = computed_once(cut, [row_id], {"dl": _count("words"), "words": F.col("words")})
    words = once.select(row_id, "dl", F.explode("words").alias("term"))
    return words.groupBy(row_id, "dl", "term").agg(F.count("*").alias("tf"))


def term_statistics(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(term, n_docs, n_occurrences) over the whole collection.

    Each row offers its words twice, as they stand and made distinct, so one scan and one shuffle with
    map-side merging of hot words count both.
    """
    cut = df.select(tokens(F.col(text)).alias("words"))
    offered = cut.select(F.posexplode(F.array("words", F.array_distinct("words"))).alias("form", "words"))
    return (
        offered.select("form", F.explode("words").alias("term"))
        .groupBy("term")
        .agg(F.count_if(F.col("form") == 1).alias("n_docs"), F.count_if(F.col("form") == 0).alias("n_occurrences"))
    )


def _listed(ids: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """(term, n_words, ids, dls, tfs): the texts that hold each word, with their lengths and how often each holds it."""
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    terms = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), lengths)
    # sorted, the distinct pairs of term and text are the lists, one after the other
    pairs, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * max(1, len(words)) + row, return_counts=True)
    code, text = np.divmod(pairs, max(1, len(words)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(terms.dictionary)))]).astype(np.int32)
    n_words = np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary)).astype(np.int64)
    columns = [ids.take(pa.array(text)), pa.array(lengths[text].astype(np.int32)), pa.array(tf.astype(np.int32))]
    lists = [pa.ListArray.from_arrays(pa.array(offsets), c) for c in columns]
    return pa.RecordBatch.from_arrays([terms.dictionary, pa.array(n_words), *lists], ["term", "n_words", "ids", "dls", "tfs"])


def _lists_by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists over runs of texts with some `CHUNK` words together, or of one longer text."""
    for batch in batches:
        for start, end in runs_of(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), CHUNK):
            yield _listed(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))


def write_index(df: DataFrame, row_id: str, text: str, path: str, buckets: int = 64) -> None:
    """Store lists of postings split by term bucket and sorted by term, a dictionary with files sorted by stem, and totals.

    A task lists its texts by term before anything is shuffled, so a row that travels or is sorted stands for many
    postings. A lookup then reads the few buckets of its words and skips row groups by term statistics. Postings
    carry the text length, so that scoring joins nothing of the collection's size. The rebalance hint lets
    the adaptive planner cut a bucket that a hot term has made large.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    id_type = df.schema[row_id].dataType.simpleString()
    cut = df.where(F.col(text).isNotNull()).select(F.col(row_id), tokens(F.col(text)).alias("words"))
    listed = cut.mapInArrow(_lists_by_task, f"term string, n_words bigint, {_lists_schema(id_type)}")
    (
        listed.withColumn("bucket", bucket)
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term")
        .write.partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    # Each distinct word is stemmed once, so the stemmer never sees running text.
    stored = df.sparkSession.read.schema("term string, n_words bigint, bucket int").parquet(f"{path}/postings")
    words = stored.select("bucket", "term").distinct()
    stems = words.select("bucket", "term", stem(F.col("term")).alias("stem"))
    stems.sortWithinPartitions("stem").write.parquet(f"{path}/words")
    # The postings know the number of words, so the texts are not read again for their lengths.
    n = df.count()
    all_words = stored.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    avgdl = F.col("words") / F.lit(max(n, 1))
    totals = all_words.select(F.lit(n).cast("bigint").alias("n"), avgdl.alias("avgdl"), F.lit(id_type).alias("id_type"))
    totals.write.parquet(f"{path}/totals")


def _lists_schema(id_type: str) -> str:
    return f"ids array<{id_type}>, dls array<int>, tfs array<int>"


def index_top_k(
    spark: SparkSession,
    path: str,
    row_id: str,
    query: str,
    k: int = 50,
    stemmed: bool = False,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """BM25 ranking from a stored index; unstemmed it equals `bm25_top_k` over the same texts.

    Stemmed, a query term stands for all words of the index with its stem, counted as one term. Postings are
    joined with the matching words by (bucket, term): whatever their number, Spark decides by size whether
    to broadcast them, and then prunes the buckets that they do not name.
    """
    terms = query_terms(query, stop_words)
    stems = sorted({stem_word(t) for t in terms})
    totals = spark.read.parquet(f"{path}/totals").first()
    dictionary = spark.read.schema("bucket int, term string, stem string").parquet(f"{path}/words")
    words = dictionary.where(F.col("stem").isin(*stems))
    if stemmed:
        words = words.select("bucket", "term", F.col("stem").alias("label"))
    else:
        words = words.where(F.col("term").isin(*terms)).select("bucket", "term", F.col("term").alias("label"))
    stored = spark.read.schema(f"term string, {_lists_schema(totals.id_type)}, bucket int").parquet(f"{path}/postings")
    listed = stored.join(words, ["bucket", "term"]).select("label", F.inline(F.arrays_zip("ids", "dls", "tfs")))
    hits = listed.withColumnsRenamed({"ids": row_id, "dls": "dl", "tfs": "tf"})
    hits = hits.groupBy(row_id, "dl", "label").agg(F.sum("tf").alias("tf"))
    # The frequencies have one row per query term.
    frequency = hits.groupBy("label").agg(F.count("*").alias("df"))
    part = _bm25_part(F.col("tf"), F.col("dl"), F.lit(totals.avgdl), _idf(F.lit(totals.n), F.col("df")))
    scored = (
        hits.join(F.broadcast(frequency), "label")
        .groupBy(row_id)
        .agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
    )
    return top_k(scored, row_id, "score", k)
