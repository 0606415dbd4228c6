"""Text columns: tokens, name keys, trigrams, entity patterns, masking."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns, kept to the syntax that Java and RE2 share.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = (
    r"(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)|\([0-9]{3}\) ?|\b(?:1[ .-])?[0-9]{3}[ .-]?)"
    r"[0-9]{3}[ .-]?[0-9]{4}\b"
)
PHONE_PARTS = r"^\+?1?[ .-]?\(?([0-9]{3})\)?[ .-]?([0-9]{3})[ .-]?([0-9]{4})$"
SSN_CORE = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
SSN_SHAPE = r"(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?:$|[^0-9-])"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
US_DATE = r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b"
LONG_DATE = (
    r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r" [0-9]{1,2}, [0-9]{4}\b"
)
DOLLARS = r"\$ ?([0-9][0-9,]*(?:\.[0-9]{2})?)"
USD_BEFORE = r"USD ?([0-9][0-9,]*(?:\.[0-9]{2})?)"
USD_AFTER = r"([0-9][0-9,]*(?:\.[0-9]{2})?) USD"
SERIAL_ID = r"\b[A-Z]{2,8}[-_ ]?[0-9]{4,10}\b"
# Forms of United States legal citation in general use, most specific first: kind and pattern.
LEGAL_FORMS = [
    ("code", r"[0-9]{1,2} U\.S\.C\.(?:A\.)? (?:§+ ?|[Cc]h(?:\.|apter) )[0-9]+[a-z]*(?:-[0-9]+)?"),
    ("regulation", r"[0-9]{1,2} C\.F\.R\. §+ ?[0-9]+(?:\.[0-9]+)?"),
    ("opinion", r"[0-9]{1,4} (?:U\.S\.|S\. Ct\.|L\. Ed\. 2d|F\.2d|F\.3d|F\.4th|F\. Supp\.(?: [23]d)?|"
     r"[ANP]\.[23]d|N\.[EW]\.[23]d|S\.[EW]\.[23]d|So\. [23]d|Cal\. (?:4th|5th)) [0-9]{1,5}"),
    ("docket", r"[0-9]:[0-9]{2}-(?:cv|cr|mc|bk)-[0-9]{3,6}|\bNos?\. [0-9]{2}-[0-9]{1,6}\b"),
    ("section", r"§+ ?[0-9]+[a-z]*(?:[.-][0-9]+)?|\b[Ss]ection [0-9]+[a-z]?(?:\.[0-9]+)?"),
]
BAR_NUMBER = r"\b(?:State )?Bar (?:No\.|Number|ID):? ?#?[0-9]{4,8}\b"
WORD = r"[a-z0-9]+"
# Fixed value: words that turn a statement into its denial.
NEGATIONS = ["cannot", "neither", "never", "no", "nobody", "none", "nor", "not", "nothing", "without"]


def tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs, in reading order, of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of runs of non-whitespace."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0)))


def name_key(name: Column) -> Column:
    """Comparison key: lower case, other characters to a space, runs of spaces to one; not trimmed."""
    lowered = F.regexp_replace(F.lower(name), r"[^a-z0-9 ]+", " ")
    return F.regexp_replace(lowered, r" +", " ")


def last_token(key: Column) -> Column:
    return F.element_at(F.split(F.trim(key), " "), -1)


def sound_key(name: Column) -> Column:
    """Soundex of the last word of the comparison key."""
    return F.soundex(last_token(name_key(name)))


def trigrams(name: Column) -> Column:
    """Distinct three-character windows of each word, with two blanks before it and one after."""
    words = F.filter(F.split(name_key(name), " "), lambda w: w != "")
    per_word = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(per_word))


def set_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; two empty ones give 0."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


# A literal that every match holds. Looking for it costs far less than the pattern and rules out most texts.
REQUIRED = {EMAIL: "@", DOLLARS: "$", USD_BEFORE: "USD", USD_AFTER: "USD", US_DATE: "/"}
#: A pattern without bounds or choices that every match holds, for those that hold no literal.
REQUIRED_SHAPE = {PHONE: "[0-9]{3}[ .-]?[0-9]{4}", ISO_DATE: "[0-9]{4}-[0-9]{2}-[0-9]{2}", SERIAL_ID: "[A-Z][-_ ]?[0-9]{4}"}


def may_match(text: Column, pattern: str) -> Column | None:
    """False only where the pattern cannot match; None for a pattern that nothing simpler is known of."""
    if pattern in REQUIRED:
        return F.contains(text, F.lit(REQUIRED[pattern]))
    return text.rlike(REQUIRED_SHAPE[pattern]) if pattern in REQUIRED_SHAPE else None


_WORD = "[0-9A-Za-z_]"


def in_java(pattern: str) -> str:
    """A pattern whose \\b means in Java what it means in RE2 and under re.ASCII: Java's own counts all letters as word."""
    return pattern.replace(r"\b", f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order, over the whole text."""
    found = F.regexp_extract_all(text, F.lit(in_java(pattern)), F.lit(group))
    likely = may_match(text, pattern)
    if likely is None:
        return found
    nothing = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(likely, found).otherwise(nothing)


def emails(text: Column) -> Column:
    """Distinct addresses in alphabetical order."""
    return F.array_sort(F.array_distinct(matches(text, EMAIL)))


def phones(text: Column) -> Column:
    """Distinct numbers as `(aaa) bbb-cccc`, in order of first appearance."""
    found = F.transform(
        matches(text, PHONE), lambda m: F.regexp_replace(m, PHONE_PARTS, "($1) $2-$3")
    )
    return F.array_distinct(found)


def bar_numbers(text: Column) -> Column:
    """Distinct registration numbers of lawyers, digits only, in order of first appearance."""
    return F.array_distinct(F.transform(matches(text, BAR_NUMBER), lambda m: F.regexp_extract(m, "[0-9]+$", 0)))


def has_ssn_shape(text: Column) -> Column:
    return text.rlike(SSN_CORE) & text.rlike(SSN_SHAPE)


def spans(text: Column, pattern: str, context: int | None = 50) -> Column:
    """Array of (start, value, context) for each match, in order; start counts characters from 1.

    Context is the text up to `context` characters around a match, with line ends as blanks; `None` leaves it out. An
    Arrow function, because no SQL function gives the place of a match, and sums over the pieces between
    matches take time with the square of their number.
    """
    return exclusive_spans(text, [pattern], context)


def exclusive_spans(text: Column, patterns: list[str], context: int | None = None) -> Column:
    """Like `spans` for several patterns: one that overlaps a match of an earlier pattern does not count."""
    finders = [re.compile(p, re.ASCII) for p in patterns]
    fields = [T.StructField("start", T.IntegerType()), T.StructField("value", T.StringType())]
    arrow = [("start", pa.int32()), ("value", pa.string())]
    if context is not None:
        fields.append(T.StructField("context", T.StringType()))
        arrow.append(("context", pa.string()))

    def found(body: str) -> list[dict]:
        taken: list[tuple[int, int]] = []
        for finder in finders:
            at, fresh = 0, []
            for m in finder.finditer(body):
                # both lists are in order, so each is walked once
                while at < len(taken) and taken[at][1] <= m.start():
                    at += 1
                if at == len(taken) or taken[at][0] >= m.end():
                    fresh.append(m.span())
            taken = sorted(taken + fresh)
        rows = []
        for start, end in taken:
            row = {"start": start + 1, "value": body[start:end]}
            if context is not None:
                row["context"] = re.sub("[\r\n]", " ", body[max(0, start - context) : end + context])
            rows.append(row)
        return rows

    @F.arrow_udf(T.ArrayType(T.StructType(fields)))
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([found(b or "") for b in batch.to_pylist()], pa.list_(pa.struct(arrow)))

    return run(text)


#: What opens a token. A text that holds it already has it written as the token numbered 0, which stands for nothing else.
TOKEN_OPEN, TOKEN_LITERAL = "[[ENTITY-", "[[ENTITY-0]]"
TOKEN = r"\[\[ENTITY-[0-9]+\]\]"


def _plain(value: Column) -> Column:
    """A pattern for a value as it is, where no word runs into it."""
    quoted = F.regexp_replace(value, r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", r"\\$1")
    # looked at as a whole: bounds are wanted only where the value itself begins or ends with a word character
    before = F.when(value.rlike(r"^[\p{L}\p{N}_]"), F.lit(r"(?<![\p{L}\p{N}_])")).otherwise("")
    after = F.when(value.rlike(r"[\p{L}\p{N}_]$"), F.lit(r"(?![\p{L}\p{N}_])")).otherwise("")
    return F.concat(before, quoted, after)


def mask_table(text: Column, names: Column | None = None) -> Column:
    """Array of (value, token) for the addresses, then the numbers, in the order they are found, then those of the known
    `names` (an array) that the text holds as whole words."""
    parts = [matches(text, EMAIL), matches(text, PHONE)]
    if names is not None:
        parts.append(F.filter(names, lambda n: F.when((n != "") & F.contains(text, n), F.rlike(text, _plain(n))).otherwise(False)))
    found = F.array_distinct(F.concat(*parts))
    return F.transform(
        found,
        lambda value, i: F.struct(
            value.alias("value"), F.concat(F.lit(TOKEN_OPEN), (i + 1).cast("string"), F.lit("]]")).alias("token")
        ),
    )


def mask(text: Column, table: Column) -> Column:
    """The text with each value of `mask_table` as its token, in one pass: leftmost first, and at one place the longest.

    What a token stands in for is never looked into again, and what looks like a token in the text itself is kept apart.
    """
    longest_first = F.array_sort(
        F.transform(table, lambda e: e["value"]),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)),
    )
    pattern = F.array_join(F.concat(F.array(F.lit(re.escape(TOKEN_OPEN))), F.transform(longest_first, _plain)), "|")
    tokens_of = F.map_concat(F.create_map(F.lit(TOKEN_OPEN), F.lit(TOKEN_LITERAL)), F.map_from_entries(F.transform(table, lambda e: F.struct(e["value"], e["token"]))))
    return _exchanged(text, pattern, lambda found: F.element_at(tokens_of, found))


def _exchanged(text: Column, pattern: Column, by) -> Column:
    """Each match exchanged, with the stretches between them as they are."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    pieces = F.zip_with(between, F.transform(found, by), lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)


def depends_on_masked(statement: Column, table: Column) -> Column:
    """Whether a statement about a masked text names one of the masked values by its token."""
    return F.exists(table, lambda e: F.contains(statement, e["token"]))


def unmask(text: Column, table: Column) -> Column:
    """Inverse of `mask`, in one pass; a token that the table does not have stays."""
    values = F.map_concat(F.create_map(F.lit(TOKEN_LITERAL), F.lit(TOKEN_OPEN)), F.map_from_entries(F.transform(table, lambda e: F.struct(e["token"], e["value"]))))
    return _exchanged(text, F.lit(TOKEN), lambda found: F.coalesce(F.try_element_at(values, found), found))


def is_negated(text: Column) -> Column:
    """Whether the text holds an odd number of negating words, at its edges too."""
    hits = F.size(F.filter(tokens(F.regexp_replace(F.lower(text), "n[\u2019']t", " not")), lambda w: w.isin(*NEGATIONS)))
    return hits % 2 == 1


def polarity_differs(left: Column, right: Column) -> Column:
    """One of two statements denies, the other does not."""
    return is_negated(left) != is_negated(right)


def sets_disagree(left: Column, right: Column) -> Column:
    """Both arrays hold values and share none."""
    return (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)


def widest_difference(runs: Column) -> Column:
    """Largest share of differing places between any two token arrays of a short list of repeated runs.

    Arrays of different length differ in every place beyond the shorter one. Meant for a handful of runs
    inside one row, not for groups of rows.
    """

    def distance(a: Column, b: Column) -> Column:
        places = F.greatest(F.size(a), F.size(b))
        differing = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
        return F.when(places > 0, differing / places).otherwise(F.lit(0.0))

    return F.coalesce(
        F.array_max(
            F.flatten(F.transform(runs, lambda a, i: F.transform(F.slice(runs, i + 2, F.size(runs)), lambda b: distance(a, b))))
        ),
        F.lit(0.0),
    )
