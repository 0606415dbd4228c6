"""Counts, coverage, votes and rates. Each is one partial aggregation before its shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.text import is_negated


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) per table."""
    return union_all(
        [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    )


def key_uniqueness(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table_name, n_rows, n_keys, is_unique) per table and its key columns."""

    def check(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
        totals = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
        return totals.select(
            F.lit(name).alias("table_name"), "n_rows", "n_keys", (F.col("n_rows") == F.col("n_keys")).alias("is_unique")
        )

    return union_all([check(name, *spec) for name, spec in tables.items()])


def facet_counts(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n): counters over several facets in one pass; a null value is not counted."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("value")) for n, c in facets.items()]
    )
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


def groups_without(df: DataFrame, group: str, having: Column) -> DataFrame:
    """Groups none of whose rows fulfils the condition (null counts as unfulfilled)."""
    return df.groupBy(group).agg(F.max(F.coalesce(having, F.lit(False))).alias("any")).where("NOT any").select(group)


def plurality(df: DataFrame, group: str, choice: str, tie: str = "tie") -> DataFrame:
    """(group, winner, votes): the one most frequent choice, or `tie`.

    Three groupings, each merged on the map side: votes per choice, choices per number of votes, and the
    largest number of votes. A group with very many choices is therefore never held in one task.
    """
    counted = df.groupBy(group, choice).agg(F.count("*").alias("votes"))
    level = counted.groupBy(group, "votes").agg(F.count("*").alias("n"), F.min(choice).alias("first"))
    top = level.groupBy(group).agg(F.max_by(F.struct("n", "first"), "votes").alias("top"), F.max("votes").alias("votes"))
    return top.select(
        group, F.when(F.col("top.n") == 1, F.col("top.first")).otherwise(F.lit(tie)).alias("winner"), "votes"
    )


def rate_by(df: DataFrame, group: str, condition: Column, neutral: float = 0.5) -> DataFrame:
    """(group, n_checked, rate): share of true among non-null checks, `neutral` where there is none."""
    share = F.count_if(condition) / F.nullif(F.count(condition), F.lit(0))
    return df.groupBy(group).agg(
        F.count(condition).alias("n_checked"), F.round(F.coalesce(share, F.lit(neutral)), 6).alias("rate")
    )


def rule_tallies(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, passed, failed, unknown) per rule, from one scan; a null outcome is unknown."""
    outcomes = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("ok")) for n, c in rules.items()])
    return (
        df.select(F.inline(outcomes))
        .groupBy("rule")
        .agg(
            F.count_if(F.col("ok")).alias("passed"),
            F.count_if(~F.col("ok")).alias("failed"),
            F.count_if(F.col("ok").isNull()).alias("unknown"),
        )
    )


def value_conflicts(df: DataFrame, entity: str, source: str, value: str) -> DataFrame:
    """(entity, n_sources, n_values): entities for which no single value is stated by all sources.

    A group is judged by counts, so sources of an entity are never compared pair by pair.
    """
    stated = df.where(F.col(value).isNotNull()).select(entity, source, value).distinct()
    per_value = stated.groupBy(entity, value).agg(F.count("*").alias("n"))
    summary = per_value.groupBy(entity).agg(F.max("n").alias("most"), F.count("*").alias("n_values"))
    sources = stated.select(entity, source).distinct().groupBy(entity).agg(F.count("*").alias("n_sources"))
    return (
        summary.join(sources, entity).where(F.col("most") < F.col("n_sources")).select(entity, "n_sources", "n_values")
    )


def polarity_conflicts(df: DataFrame, key: str, statement: str) -> DataFrame:
    """(key, n_affirmed, n_denied) of keys that have statements of both kinds.

    Statements are told apart by their negating words. Counting both kinds finds every key with an opposed pair
    without forming pairs, and merges on the map side.
    """
    denied = is_negated(F.col(statement))
    counted = df.groupBy(key).agg(F.count_if(~denied).alias("n_affirmed"), F.count_if(denied).alias("n_denied"))
    return counted.where("n_affirmed > 0 AND n_denied > 0")
