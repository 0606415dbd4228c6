"""A quality classifier made of rules: tree paths over text statistics, weighted by a lasso.

A small forest is grown on labelled rows. Every path from a root to a node is a conjunction of bounds on
statistics; a logistic regression with an L1 penalty keeps few of these rules and gives each a weight (rule
ensembles, Friedman and Popescu 2008). What is left becomes one Spark column expression, so scoring is a
projection over the texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import stored, text_or_empty

#: The most labelled rows a classifier is fitted on; all rows are scored.
FIT_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.0005, 17


def statistics(text: Column) -> Column:
    """A struct of statistics of one text, none of which depends on its language, source or identifier."""
    parts = F.struct(text.alias("t"), F.split(F.trim(text), r"\s+").alias("w"), F.split(text, "\n").alias("l"))

    def measure(p: Column) -> Column:
        t, w, lines = p["t"], p["w"], p["l"]
        n, n_words = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(w), F.lit(1))

        def share(pattern: str) -> Column:
            return F.regexp_count(t, F.lit(pattern)) / n

        return F.struct(
            F.log1p(F.length(t).cast("double")).alias("log_chars"),
            (n / n_words).alias("word_chars"),
            (F.size(F.array_distinct(w)) / n_words).alias("distinct_words"),
            (F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))) / n_words).alias("repeated_words"),
            (F.size(F.filter(w, lambda x: F.length(x) <= 3)) / n_words).alias("short_words"),
            (F.size(F.array_distinct(lines)) / F.size(lines)).alias("distinct_lines"),
            (F.size(lines) / n_words).alias("lines_per_word"),
            share("[A-Z]").alias("capitals"),
            share("[0-9]").alias("digits"),
            share("[.,;:]").alias("stops"),
            share("[!?]").alias("marks"),
            share(r"[#$%&*@=<>~^+{}\[\]\\_]").alias("symbols"),
            share(r"\|").alias("bars"),
            share("https?://|www[.]").alias("links"),
            share(r"[^\x00-\x7F]").alias("beyond_ascii"),
        )

    # a one-element array, so that the words are cut once for all statistics
    return F.get(F.transform(F.array(parts), measure), F.lit(0))


STATISTICS = (
    "log_chars word_chars distinct_words repeated_words short_words distinct_lines lines_per_word capitals digits stops "
    "marks symbols bars links beyond_ascii"
).split()


@dataclass(frozen=True)
class Rule:
    """Bounds that all hold: (statistic, low, high] for each."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, stats: Column) -> Column:
        tests = []
        for name, low, high in self.bounds:
            if low > -math.inf:
                tests.append(stats[name] > low)
            if high < math.inf:
                tests.append(stats[name] <= high)
        result = tests[0]
        for test in tests[1:]:
            result = result & test
        return result


def tree_paths(printed: str) -> set[Rule]:
    """The rules of all nodes of a fitted forest, read from its printed form."""
    rules: set[Rule] = set()
    path: list[tuple[int, str, float, float]] = []  # (indent, statistic, low, high)
    for line in printed.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not found:
            continue
        indent, name, cut = len(found[1]), STATISTICS[int(found[2])], float(found[4])
        path = [p for p in path if p[0] < indent]
        path.append((indent, name, *((-math.inf, cut) if found[3] == "<=" else (cut, math.inf))))
        merged: dict[str, tuple[float, float]] = {}
        for _, statistic, low, high in path:
            a, b = merged.get(statistic, (-math.inf, math.inf))
            merged[statistic] = (max(a, low), min(b, high))
        rules.add(Rule(tuple((s, a, b) for s, (a, b) in sorted(merged.items()))))
    return rules


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and an intercept; without rules every text has the same score."""

    intercept: float
    weighted: tuple[tuple[float, Rule], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.weighted:
            total = total + F.when(rule.column(stats), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text is a multiple of 5. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """Learn from at most `fit_rows` labelled rows outside the held-out fold, chosen by a hash of their id.

    Only the labels 0 and 1 are used, not null, other values, or labels of no document. An id counts once: with its
    smallest label, and of several texts with the one whose hash is smallest. With one class only, or none, the score is
    the share of that class with one row of each added.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(id_col).agg(F.min(F.col(label_col).cast("double")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(SEED), id_col), id_col).limit(fit_rows)
    # the chosen labels are few by construction, so they go to the texts; of these only the chosen ones are shuffled
    texts = docs.select(id_col, text_or_empty(F.col(text_col)).alias("text")).join(F.broadcast(chosen), id_col)
    texts = texts.groupBy(id_col, "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = stored(texts.select("label", statistics(F.col("text")).alias("s")), "quality-fit")
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if count.get(0.0, 0) == 0 or count.get(1.0, 0) == 0:
        ones, total = count.get(1.0, 0) + 1, sum(count.values()) + 2
        return RuleEnsemble(math.log(ones / (total - ones)), ())
    values = F.array(*[F.col("s")[name] for name in STATISTICS])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="0.5",
                                    minInstancesPerNode=10).fit(
        rows.select("label", array_to_vector(values).alias("features")))
    rules = sorted(tree_paths(forest.toDebugString), key=lambda rule: rule.bounds)
    if not rules:
        return RuleEnsemble(math.log(count[1.0] / count[0.0]), ())
    holds = F.array(*[rule.column(F.col("s")).cast("double") for rule in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(
        rows.select("label", array_to_vector(holds).alias("features"))
    )
    weighted = tuple((float(w), rule) for w, rule in zip(lasso.coefficients, rules) if w != 0.0)
    return RuleEnsemble(float(lasso.intercept), weighted)


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score >= threshold), then the columns of `carry`.

    A null text scores like the empty one. Rows are judged alone, so repeats get equal scores.
    """
    measured = docs.select(F.col(id_col).alias("doc_id"), *carry, statistics(text_or_empty(F.col(text_col))).alias("s"))
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("s")).alias("score"),
                             *carry)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
