"""Secret scans: fixed credential patterns plus strings of high entropy, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.common import stored, text_or_empty

#: Pattern, the group whose length counts, and its least length, for each kind of credential (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

#: Characters of a window.
WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharacterClass:
    """A kind of random string: its maximal runs, the bits per character that a window must reach, and what it must match."""

    runs: str
    least_bits: float
    needs: tuple[str, ...]


#: One in a hundred windows of random characters of the class lies below its limit; the limits are numbers that no window has.
#: What each class needs beside tells it from digits, from words, and from paths and names made of words (fixed values).
CLASSES = (
    CharacterClass(r"[0-9a-f]{20,}|[0-9A-F]{20,}", 2.9, ("[0-9]", "[a-fA-F]")),
    CharacterClass(r"[0-9a-z]{20,}", 3.4, ("[0-9].*[0-9]", "[a-z]")),
    CharacterClass(r"[A-Za-z0-9+/_-]{20,}", 3.63, ("[A-Z]", "[a-z]", "[0-9+]|[A-Z][A-Z]", "^[^/_-]*([/_-][^/_-]*){0,3}$")),
)
#: Text without such a run has none of any class.
CANDIDATE = CLASSES[2].runs
#: What looks random but is known not to be a secret, and its characters: identifiers of the standard form and the placeholders
#: of manuals. No window reaches into it.
ALLOWED = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", 36),
    ("(?i)placeholder", 11),
    ("(?i)0123456789", 10),
    ("(?i)abcdefghij", 10),
    ("(?i)changeme", 8),
    ("(?i)example", 7),
    ("(?i)xxxxxx", 6),
)
#: Stands for the characters of what is allowed; no class has it.
CUT = "#"


def without_allowed(text: Column) -> Column:
    """The text with every character of an allow-list entry replaced, so that runs end there and nothing moves."""
    for pattern, n in ALLOWED:
        text = F.regexp_replace(text, pattern, CUT * n)
    return text


def has_random_window(run: Column, of: CharacterClass, window: int = WINDOW) -> Column:
    """Whether any `window` characters of a run have the Shannon entropy and the looks of its class.

    Moving the window one character changes two counts. With f(c) = c log2 c, the entropy of a window of w characters is
    log2 w - sum f(count) / w, so the sum is carried along and only the two counts that change are taken again.
    """
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    most = window * (math.log2(window) - of.least_bits)

    def found(chars: Column) -> Column:
        def times(ch: Column, first: Column, n: int | Column) -> Column:
            return F.size(F.filter(F.slice(chars, first, n), lambda x: x == ch))

        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(chars, i - 1), F.get(chars, i - 1 - window)
            # the characters between: from the one behind the leaving one to the one before the entering one
            first = F.greatest(i - window + 1, F.lit(1))
            n_in = times(enters, first, i - first)
            n_out = F.when(i > window, times(leaves, first, i - first) + 1).otherwise(0)
            total = state["total"] + F.get(f, n_in + 1) - F.get(f, n_in)
            total = total - F.when(n_out > 0, F.get(f, n_out) - F.get(f, n_out - 1)).otherwise(0.0)
            text = F.array_join(F.slice(chars, first, F.lit(window)), "")
            looks = F.lit(True)
            for pattern in of.needs:
                looks = looks & text.rlike(pattern)
            hit = F.when((i >= window) & (total <= most), looks).otherwise(False)
            return F.when(state["hit"], state).otherwise(F.struct(total.alias("total"), hit.alias("hit")))

        start = F.struct(F.lit(0.0).alias("total"), F.lit(False).alias("hit"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda end: end["hit"])

    # the lambda of a one-element array names the characters, so that the run is cut once and not per step
    return F.get(F.transform(F.array(F.split(run, "")), found), F.lit(0))


def _pieces(kind: int, text: Column, pattern: str, keep) -> Column:
    """The leftmost non-overlapping matches of a text as (kind, i, gap, n, keep): match i has n characters and
    stands `gap` characters behind the one before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else found
    return F.when(
        text.rlike(pattern),
        F.transform(
            F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(gaps) - 1).alias("g"), groups.alias("v")),
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                F.length(x["g"]).alias("gap"),
                F.length(x["m"]).alias("n"),
                keep(x["v"]).alias("keep"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,keep:boolean>>"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, pieces) and their spans (row, kind, start, end), in code points, end exclusive."""
    text = text_or_empty(F.col(text_col))
    cut = F.when(text.rlike(CANDIDATE), without_allowed(text)).otherwise("")
    pieces = F.concat(
        _pieces(0, text, ASSIGN, lambda v: F.length(v) >= ASSIGN_CHARS),
        _pieces(1, text, ACCESS, lambda v: F.length(v) >= ACCESS_CHARS),
        _pieces(2, text, HEX, lambda v: F.lit(True)),
        *[_pieces(3 + k, cut, c.runs, lambda v, c=c: has_random_window(v, c)) for k, c in enumerate(CLASSES)],
    )
    rows = stored(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), pieces.alias("pieces")),
        "secret-pieces",
    )
    # positions are running sums over the pieces of one text, all of which came out of one row
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    flat = rows.filter(F.size("pieces") > 0).select("row", F.inline("pieces"))
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    spans = flat.withColumn("end", end).filter("keep").select("row", "kind", (F.col("end") - F.col("n")).alias("start"), "end")
    # of runs that lie within each other the longest is told, once: those before it in this order must end before it does
    earlier = Window.partitionBy("row", "random").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    told = spans.withColumn("random", F.col("kind") >= 3).withColumn("reach", F.max("end").over(earlier))
    told = told.filter("NOT random OR reach IS NULL OR reach < end")
    return rows, told.select("row", F.least("kind", F.lit(3)).alias("kind"), "start", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    `spans` lists kind:start:end of all kinds by start, then by kind in the order assign, access, hex, entropy;
    `base_sha256` is the digest of the same list without entropy spans. A null text is empty, a text without
    finds has an empty list. Repeated rows have repeated results and extra columns are ignored.
    """
    rows, spans = secret_spans(docs, id_col, text_col)
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
    )

    def written(found: Column) -> Column:
        one = F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
        return F.coalesce(F.array_join(one, ","), F.lit(""))

    base = F.filter("s", lambda x: x["kind"] < 3)
    return rows.select("row", "doc_id").join(listed, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("s")).alias("spans"),
    )
