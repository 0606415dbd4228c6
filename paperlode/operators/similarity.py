"""Fuzzy matching of names: ranked lookup, edit distance, sound groups, and an exact similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.text import set_similarity, sound_key, trigrams
from paperlode.operators.once import computed_once
from paperlode.session import shared_dir


def distinct_names(df: DataFrame, name: str) -> DataFrame:
    """(name, n_rows); copies of a name are merged on the map side before anything compares them."""
    return df.groupBy(name).agg(F.count("*").alias("n_rows"))


def similar_names(df: DataFrame, name: str, query: str, k: int) -> DataFrame:
    """The k names closest to the query by trigram similarity."""
    score = F.round(set_similarity(trigrams(F.col(name)), trigrams(F.lit(query))), 6)
    scored = distinct_names(df, name).withColumn("similarity", score)
    return scored.orderBy(F.desc("similarity"), name).limit(k)


def nearest_spellings(df: DataFrame, name: str, query: str, max_edits: int) -> DataFrame:
    """Names within `max_edits` edits of the query; the threshold lets Spark stop each comparison early."""
    edits = F.levenshtein(F.col(name), F.lit(query), max_edits)
    return distinct_names(df, name).withColumn("edits", edits).where("edits >= 0")


def sound_groups(df: DataFrame, name: str) -> DataFrame:
    """(sound, n_names, n_rows): names grouped by how their last word sounds."""
    return (
        distinct_names(df, name)
        .groupBy(sound_key(F.col(name)).alias("sound"))
        .agg(F.count("*").alias("n_names"), F.sum("n_rows").alias("n_rows"))
    )


def similarity_join(df: DataFrame, name: str, threshold: float) -> DataFrame:
    """(left_name, right_name, similarity): all pairs of distinct names at or above a trigram similarity.

    Prefix filtering (Chaudhuri et al. 2006; with longer prefixes Wang et al. 2012): two sets that reach
    Jaccard t have at least p = ceil(t|s|) members in common, and the first two of these lie among the
    |s| - p + 2 rarest members of each. Pairs of rare members are the join keys, which leaves few
    candidates, and the result is exact. Sets so small that p < 2 join by one member; they have no more
    than 1/t trigrams, so there are only a handful of them and of the sets close enough in size.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    names = df.select(F.col(name).alias("name")).distinct()
    sets = computed_once(names, ["name"], {"grams": trigrams(F.col("name"))}).where(F.size("grams") > 0)
    members = sets.select("name", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    rarity = members.groupBy("gram").agg(F.count("*").alias("freq"))
    by_rarity = members.join(rarity, "gram").groupBy("name", "n").agg(
        F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("ranked")
    )
    # A name's trigrams are bounded by its own length, so the lists above are as small as the names.
    sized = by_rarity.select(
        "name", "n", F.col("ranked.gram").alias("grams"),
        F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int").alias("p"),
    )
    # Four branches read these rows, so they are stored once in the shared folder.
    path = shared_dir(df.sparkSession, "names")
    sized.write.parquet(path)
    sized = df.sparkSession.read.parquet(path)
    single = sized.select("name", "n", "p", F.explode(F.slice("grams", 1, F.col("n") - F.col("p") + 1)).alias("key"))
    double = (
        sized.where("p >= 2")
        .withColumn("prefix", F.slice("grams", 1, F.col("n") - F.col("p") + 2))
        .select("name", "n", F.explode(_pairs(F.col("prefix"))).alias("key"))
    )
    small = single.where("p < 2").select("name", "n", "key")
    near = single.where(F.col("n") <= 1 / threshold**2 + 1e-9).select("name", "n", "key")
    candidates = (
        _matching(double, double, threshold).unionByName(_matching(small, near, threshold)).distinct()
    )
    score = set_similarity(trigrams(F.col("left_name")), trigrams(F.col("right_name")))
    return candidates.withColumn("similarity", F.round(score, 6)).where(F.col("similarity") >= threshold)


def _pairs(items: Column) -> Column:
    """All two-element combinations of an array, in its order, as joined strings."""
    return F.flatten(
        F.transform(
            items,
            lambda a, i: F.transform(
                F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda b: F.concat(a, F.lit("\x1f"), b)
            ),
        )
    )


def _matching(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Ordered name pairs that share a key and are close enough in size."""
    a = left.select(F.col("name").alias("a"), F.col("n").alias("a_n"), "key")
    b = right.select(F.col("name").alias("b"), F.col("n").alias("b_n"), "key")
    close = F.least("a_n", "b_n") >= F.lit(threshold) * F.greatest("a_n", "b_n") - 1e-9
    return (
        a.join(b, "key")
        .where((F.col("a") != F.col("b")) & close)
        .select(F.least("a", "b").alias("left_name"), F.greatest("a", "b").alias("right_name"))
    )
