"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index stores, for every term that a benchmark item uses, its postings (row, position) in the training
texts. A window of an item is looked up from its rarest terms: a posting less the term's offset says where the
item would have to start in the text, and only places that the lists of the rarest terms share go on. At these
the lists of the other terms are intersected in the same way, and runs of agreeing offsets are the exact phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.common import broadcast_if_small, stored, words


def index_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, item_id, n_item, offset, term_id) of all benchmark words, and the vocabulary (term, term_id)."""
    cut = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("string").alias("item_id"),
                       words(F.col(text_col)).alias("w"))
    terms = stored(cut.select("item", "item_id", F.size("w").alias("n_item"),
                              F.posexplode("w").alias("offset", "term")), "item-terms")
    distinct = terms.select("term").distinct().select("term", (F.monotonically_increasing_id() + 1).alias("term_id"))
    vocabulary = stored(distinct, "vocabulary")
    return stored(terms.join(vocabulary, "term").drop("term"), "item-postings"), vocabulary


def index_documents(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (row, doc_id, pos, term_id) of the vocabulary's terms. Each text also has one posting of term 0
    behind its last word, so that its position is the number of words."""
    end = vocabulary.sparkSession.createDataFrame([("", 0)], "term string, term_id bigint")
    known = broadcast_if_small(stored(vocabulary.unionByName(end), "vocabulary"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        F.array_append(words(F.col(text_col)), F.lit("")).alias("w"))
    return stored(
        texts.select("row", "doc_id", F.posexplode("w").alias("pos", "term")).join(known, "term").drop("term"),
        "postings",
    )


def rarest_terms(item_terms: DataFrame, postings: DataFrame, window: int, lists: int) -> DataFrame:
    """(item, offset, term_id, needed): the rarest terms of every window of every item, each place once.

    A window with a term that no text has cannot occur and needs no look-up.
    """
    counted = postings.filter("term_id > 0").groupBy("term_id").agg(F.count("*").alias("postings"))
    rows = item_terms.join(stored(counted, "term-counts"), "term_id", "left").fillna(0, ["postings"])
    ahead = Window.partitionBy("item").orderBy("offset").rowsBetween(0, window - 1)
    pick = F.slice(F.sort_array(F.collect_list(F.struct("postings", "offset", "term_id")).over(ahead)), 1, lists)
    starts = F.col("offset") <= F.greatest(F.col("n_item") - window, F.lit(0))
    picked = rows.select("item", "offset", "n_item", pick.alias("r")).filter(starts).filter("r[0].postings > 0")
    return picked.select("item", F.least(F.lit(lists), "n_item").alias("needed"), F.inline("r")).drop("postings").distinct()


def alignments(item_terms: DataFrame, postings: DataFrame, window: int, lists: int = 3) -> DataFrame:
    """(row, item, shift): where an item would start in a text, by the postings of its rarest terms.

    Only these lists are intersected here: a window that occurs has all of its `lists` rarest terms in the same
    alignment, so a place with fewer is no candidate.
    """
    rare = broadcast_if_small(stored(rarest_terms(item_terms, postings, window, lists), "rarest"))
    found = postings.join(rare, "term_id").select(
        "row", "item", (F.col("pos") - F.col("offset")).alias("shift"), "offset", "needed"
    )
    met = found.groupBy("row", "item", "shift").agg(
        F.size(F.collect_set("offset")).alias("met"), F.first("needed").alias("needed")
    )
    return stored(met.filter("met >= needed").drop("met", "needed"), "alignments")


def agreeing(item_terms: DataFrame, postings: DataFrame, places: DataFrame) -> DataFrame:
    """(row, item, item_id, n_item, shift, offset): the words of an item that a text has at the aligned place."""
    rows = broadcast_if_small(stored(places.select("row").distinct(), "aligned-rows"))
    near = postings.filter("term_id > 0").join(rows, "row", "left_semi").select("row", "pos", "term_id")
    wanted = places.join(broadcast_if_small(item_terms), "item").withColumn("pos", F.col("shift") + F.col("offset"))
    return wanted.join(near, ["row", "pos", "term_id"]).drop("pos", "term_id")


def phrase_matches(item_terms: DataFrame, postings: DataFrame, window: int = 13) -> DataFrame:
    """(row, item, item_id, start, end): maximal stretches of a text that are covered by windows of an item.

    Offsets that agree without a gap form a run; a run of `window` words (or of the whole item if it is shorter)
    is a stretch of overlapping occurrences.
    """
    hits = agreeing(item_terms, postings, alignments(item_terms, postings, window))
    line = Window.partitionBy("row", "item", "shift").orderBy("offset")
    runs = hits.withColumn("run", F.col("offset") - F.row_number().over(line)).groupBy("row", "item", "shift", "run")
    spans = runs.agg(F.first("item_id").alias("item_id"), F.first("n_item").alias("n_item"),
                     F.min("offset").alias("first"), F.count("*").alias("n"))
    start = F.col("shift") + F.col("first")
    return spans.filter(F.col("n") >= F.least(F.lit(window), F.col("n_item"))).select(
        "row", "item", "item_id", start.alias("start"), (start + F.col("n")).alias("end")
    )


def near_alignments(item_terms: DataFrame, postings: DataFrame, lists: int, slop: int, share: float) -> DataFrame:
    """(row, item, shift): where an item may stand in a text with words moved, replaced or missing.

    Of an item with n words that any text has, n - need can be missing when `need` must be met. So among its n - need + k
    rarest words at least k are met, wherever the others are; only the lists of these are intersected, each within
    `slop`. Words that no text has are met nowhere and are not among them.
    """
    counted = postings.filter("term_id > 0").groupBy("term_id").agg(F.count("*").alias("postings"))
    known = item_terms.join(stored(counted, "term-counts"), "term_id").withColumn("need", _least_words(share))
    of_item = Window.partitionBy("item")
    ranked = known.withColumn("present", F.count("*").over(of_item)).withColumn(
        "place", F.row_number().over(of_item.orderBy("postings", "offset"))
    )
    needed = F.least(F.lit(lists), "need")
    rare = ranked.filter(F.col("present") >= F.col("need")).filter(F.col("place") <= F.col("present") - F.col("need") + needed)
    rare = broadcast_if_small(stored(rare.select("item", "offset", "term_id", needed.alias("needed")), "rarest"))
    shift = F.explode(F.sequence(F.col("pos") - F.col("offset") - slop, F.col("pos") - F.col("offset") + slop))
    found = postings.join(rare, "term_id").select("row", "item", "offset", "needed", shift.alias("shift"))
    met = found.groupBy("row", "item", "shift").agg(
        F.count_distinct("offset").alias("met"), F.first("needed").alias("needed")
    )
    return stored(met.filter("met >= needed").drop("met", "needed"), "alignments")


def _least_words(share: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(share * F.col("n_item") - 1e-9)).cast("int")


def proximity_matches(item_terms: DataFrame, postings: DataFrame, window: int = 13, slop: int = 5,
                      share: float = 0.8) -> DataFrame:
    """(row, item, shift, words): every place where at least `share` of an item's words stand within `slop` words of
    where the shift puts them; one match is found at all neighbouring shifts that meet this.

    `window` is at most the number of rarest words that are looked up together; the places do not depend on it.
    """
    places = near_alignments(item_terms, postings, min(3, window), slop, share)
    rows = broadcast_if_small(stored(places.select("row").distinct(), "aligned-rows"))
    near = postings.filter("term_id > 0").join(rows, "row", "left_semi").select("row", "pos", "term_id")
    moved = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    wanted = places.join(broadcast_if_small(item_terms), "item").select("*", moved.alias("move"))
    met = wanted.withColumn("pos", F.col("shift") + F.col("offset") + F.col("move")).join(near, ["row", "pos", "term_id"])
    counted = met.groupBy("row", "item", "shift").agg(
        F.count_distinct("offset").alias("words"), F.first("n_item").alias("n_item")
    )
    return counted.filter(F.col("words") >= _least_words(share)).drop("n_item")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, doc_id: str = "doc_id",
                  doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  slop: int | None = None, share: float = 0.8) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    With `slop` there is also n_near, the number of items of which the text has `share` of the words at one place, each at
    most `slop` words from where it belongs; an item that the text has word by word is one of them.

    A word is hit if an occurrence of a window covers it; a document is contaminated if at least one in `one_in`
    of its words is hit. A null text has no words and is clean; so is any text if there are no items. Items
    without words are never found; items without an id are hit but neither counted nor listed. Repeated
    documents have repeated results; items with one id count once. Extra columns are ignored.
    """
    item_terms, vocabulary = index_items(items, item_id, item_text)
    postings = index_documents(docs, vocabulary, doc_id, doc_text)
    spans = stored(phrase_matches(item_terms, postings, window), "phrases")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start")))
    covered = spans.withColumn("covered", F.greatest(F.lit(0), F.col("end") - reached))
    hit = covered.groupBy("row").agg(F.sum("covered").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("ids"))
    texts = postings.filter("term_id = 0").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    extra = []
    if slop is not None:
        places = stored(proximity_matches(item_terms, postings, window, slop, share).select("row", "item").distinct(), "near-items")
        # one row for each item of the benchmark
        known = broadcast_if_small(stored(item_terms.select("item", "item_id").distinct(), "items"))
        near = places.join(known, "item").groupBy("row").agg(F.count_distinct("item_id").alias("near"))
        texts = texts.join(near, "row", "left")
        extra = [F.coalesce("near", F.lit(0)).cast("long").alias("n_near")]
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return texts.join(hit, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words"), one_in).alias("contaminated"),
        *extra,
    )


def contaminated(n_hit: Column, n_words: Column, one_in: int) -> Column:
    return (n_hit > 0) & (one_in * n_hit >= n_words)
