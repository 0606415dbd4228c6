"""Documents to parts: byte chunks, HTML sections, document types, text records."""

from __future__ import annotations

import html as entities

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperlode.functions import text as T
from paperlode.operators.integrity import new_content
from paperlode.operators.once import computed_once

# Type by URI scheme, then by file extension.
TYPE_BY_SCHEME = {"mailto": "email", "tel": "call", "sms": "message"}
TYPE_BY_EXTENSION = {"html": "page", "htm": "page", "pdf": "pdf", "eml": "email", "txt": "text", "docx": "document"}

#: A heading's start tag; tags may hold any white space, also line ends.
HEADING = r"(?i)<h[1-6](?:\s[^>]*)?>"
#: What is never shown, each up to its own end tag.
UNSEEN = [r"<!--.*?-->", *[rf"<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>" for tag in ("script", "style", "head")]]


def byte_chunks(df: DataFrame, row_id: str, text: str, size: int = 8192) -> DataFrame:
    """(id, chunk_id, chunk_no, byte_offset, byte_size, chunk_hash) of fixed-size chunks; empty text has none.

    Chunks are hashed inside the row and only the small structs are exploded, so the text is not
    copied once per chunk and nothing is shuffled.
    """
    # Encoded once per text; inside the lambda it would be encoded once per chunk.
    encoded = computed_once(df, [row_id], {"raw": F.encode(F.col(text), "UTF-8")})
    raw = F.col("raw")
    count = F.ceil(F.octet_length(raw) / size).cast("int")
    parts = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)),
        lambda i: F.struct(
            i.alias("chunk_no"),
            (i * size).cast("bigint").alias("byte_offset"),
            F.substring(raw, i * size + 1, F.lit(size)).alias("bytes"),
        ),
    )
    described = F.transform(
        parts,
        lambda p: F.struct(
            p["chunk_no"].alias("chunk_no"),
            p["byte_offset"].alias("byte_offset"),
            F.octet_length(p["bytes"]).alias("byte_size"),
            F.sha2(p["bytes"], 256).alias("chunk_hash"),
        ),
    )
    parts = encoded.select(F.col(row_id), F.inline(described))
    chunk_id = F.format_string("%s-%06d", F.col(row_id).cast("string"), F.col("chunk_no"))
    return parts.select(row_id, chunk_id.alias("chunk_id"), "chunk_no", "byte_offset", "byte_size", "chunk_hash")


def html_sections(df: DataFrame, row_id: str, html: str) -> DataFrame:
    """(id, section_no, title, body): the text under each heading carries that heading's title.

    Text before the first heading, or a page without one, forms a section without a title.
    Cutting in front of each heading puts the title at the head of its own piece, so no window
    is needed to carry it forward. Character references are decoded. Sections without text are dropped; numbering keeps
    their places.
    """
    visible = F.regexp_replace(F.col(html), "(?is)" + "|".join(UNSEEN), " ")
    pieces = df.select(F.col(row_id), F.posexplode(F.split(visible, HEADING, -1)).alias("section_no", "piece"))
    has_title = F.col("section_no") > 0
    cut = F.regexp_extract(F.col("piece"), r"(?is)^(.*?)</h[1-6]\s*>", 1)
    rest = F.regexp_replace(F.col("piece"), r"(?is)^.*?</h[1-6]\s*>", "")
    return pieces.select(
        row_id,
        "section_no",
        F.when(has_title, _plain(cut)).alias("title"),
        _plain(F.when(has_title, rest).otherwise(F.col("piece"))).alias("body"),
    ).where("body <> ''")


def email_parts(df: DataFrame, row_id: str, message: str, fields: list[str]) -> DataFrame:
    """(id, one column per header field, body) of RFC 5322 messages.

    The head ends at the first empty line. Folded lines are unfolded; of a repeated field the first counts, and a
    field that is absent is null. A message without an empty line has no body.
    """
    cut = F.regexp_extract(F.col(message), r"(?s)^(.*?)\r?\n\r?\n(.*)$", 1)
    has_body = F.col(message).rlike(r"\r?\n\r?\n")
    head = F.regexp_replace(F.when(has_body, cut).otherwise(F.col(message)), r"\r?\n[ \t]+", " ")
    body = F.regexp_extract(F.col(message), r"(?s)^.*?\r?\n\r?\n(.*)$", 1)

    def field(name: str) -> Column:
        pattern = rf"(?im)^{name}:[ \t]*([^\r\n]*)"
        return F.when(F.col("head").rlike(pattern), F.regexp_extract("head", pattern, 1))

    parts = computed_once(df, [row_id], {"head": head, "body": body})
    return parts.select(row_id, *[field(f).alias(f.lower().replace("-", "_")) for f in fields], "body")


@F.arrow_udf(StringType())
def _unescaped(batch: pa.Array) -> pa.Array:
    """Character references decoded."""
    return pa.array([t if t is None or "&" not in t else entities.unescape(t) for t in batch.to_pylist()], pa.string())


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(_unescaped(F.regexp_replace(html, r"<[^>]*>", " ")), r"[ \t\r\n]+", " "))


def document_type(uri: Column) -> Column:
    """Type by scheme, else by the extension of the path, else 'file'."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    extension = F.lower(F.regexp_extract(uri, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.coalesce(_lookup(TYPE_BY_SCHEME, scheme), _lookup(TYPE_BY_EXTENSION, extension), F.lit("file"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def text_records(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per document: word count and what each extractor found, in one pass."""
    body = F.col(text)
    return df.select(
        row_id,
        T.word_count(body).alias("n_words"),
        T.emails(body).alias("emails"),
        T.phones(body).alias("phones"),
        T.has_ssn_shape(body).alias("has_ssn_shape"),
    )


def found_spans(df: DataFrame, row_id: str, text: str, patterns: dict[str, str], context: int = 50) -> DataFrame:
    """(id, kind, start, value, context) of every match of every pattern."""

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(
            T.spans(F.col(text), pattern, context),
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["value"].alias("value"),
                s["context"].alias("context"),
            ),
        )

    # rows that cannot have a match stay in the JVM; the others are searched once, where their matches are placed
    some = F.lit(False)
    for pattern in patterns.values():
        likely = T.may_match(F.col(text), pattern)
        some = some | (F.col(text).rlike(T.in_java(pattern)) if likely is None else likely)
    return df.where(some).select(row_id, F.inline(F.concat(*[of_kind(*item) for item in patterns.items()])))


def found_dates(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, day, form): ISO, then month/day/year, then month name; impossible dates fall away.

    A day written in several forms appears once, under the first form in that order.
    """
    forms = [
        ("iso", T.ISO_DATE, "yyyy-MM-dd"),
        ("us", T.US_DATE, "M/d/yyyy"),
        ("long", T.LONG_DATE, "MMMM d, yyyy"),
    ]

    def in_form(rank: int, pattern: str, shape: str) -> Column:
        return F.transform(
            T.matches(F.col(text), pattern),
            lambda m: F.struct(
                F.try_to_timestamp(m, F.lit(shape)).cast("date").alias("day"), F.lit(rank).alias("rank")
            ),
        )

    candidates = F.concat(*[in_form(i, pattern, shape) for i, (_, pattern, shape) in enumerate(forms)])
    names = F.array(*[F.lit(name) for name, _, _ in forms])
    every = df.select(row_id, F.inline(candidates)).where("day IS NOT NULL")
    found = every.groupBy(row_id, "day").agg(F.min("rank").alias("rank"))
    return found.select(row_id, "day", F.element_at(names, F.col("rank") + 1).alias("form"))


def date_flags(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, value, possible): everything in the form of a date, each once per text, and whether there is such a day.

    `found_dates` leaves impossible ones out; these are what a person should look at.
    """
    forms = [(T.ISO_DATE, "yyyy-MM-dd"), (T.US_DATE, "M/d/yyyy"), (T.LONG_DATE, "MMMM d, yyyy")]

    def of_form(pattern: str, shape: str) -> Column:
        return F.transform(
            F.array_distinct(T.matches(F.col(text), pattern)),
            lambda m: F.struct(m.alias("value"), F.try_to_timestamp(m, F.lit(shape)).isNotNull().alias("possible")),
        )

    return df.select(row_id, F.inline(F.concat(*[of_form(*form) for form in forms])))


def found_amounts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, start, value, amount): dollar signs, then `USD n`, then `n USD`; a form that overlaps an earlier one does not
    count, so `$100 USD` is one amount. `value` is the text as found; `amount` is null only beyond 36 digits.
    """
    forms = [T.DOLLARS, T.USD_BEFORE, T.USD_AFTER]
    some = F.lit(False)
    for pattern in forms:
        likely = T.may_match(F.col(text), pattern)
        some = some | (F.col(text).rlike(T.in_java(pattern)) if likely is None else likely)
    found = df.where(some).select(row_id, F.inline(T.exclusive_spans(F.col(text), forms)))
    return found.withColumn("amount", F.regexp_replace("value", r"[^0-9.]", "").try_cast("decimal(38,2)"))


def serial_ids(df: DataFrame, row_id: str, text: str, stop_prefixes: tuple[str, ...]) -> DataFrame:
    """(id, serial): upper-case prefix plus number, unless the prefix is a stop word; each once per text."""
    kept = F.filter(
        F.array_distinct(T.matches(F.col(text), T.SERIAL_ID)),
        lambda m: ~F.regexp_extract(m, r"^[A-Z]+", 0).isin(*stop_prefixes),
    )
    return df.select(row_id, F.explode(kept).alias("serial"))


def merged_finds(df: DataFrame, row_id: str, text: str, extractors: list[tuple[str, str]]) -> DataFrame:
    """(id, value, kind): union of (kind, pattern) extractors; a value found twice keeps its first kind."""

    def finds(rank: int, kind: str, pattern: str) -> Column:
        return F.transform(
            T.matches(F.col(text), pattern),
            lambda m: F.struct(m.alias("value"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank")),
        )

    every = F.concat(*[finds(i, kind, pattern) for i, (kind, pattern) in enumerate(extractors)])
    rows = df.select(row_id, F.inline(every))
    return first_by_precedence(rows, [row_id, "value"], "rank").select(row_id, "value", "kind")


def legal_references(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, reference, kind): legal citations, each canonical form once per text.

    The canonical form has single spaces and one section sign. A bare section is dropped where a longer
    citation of the same text ends with it.
    """

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(
            T.matches(F.col(text), pattern),
            lambda m: F.struct(
                F.regexp_replace(F.regexp_replace(m, "§+ ?", "§ "), " +", " ").alias("reference"),
                F.lit(kind).alias("kind"),
            ),
        )

    *longer, section = T.LEGAL_FORMS
    found = computed_once(
        df,
        [row_id],
        {
            "longer": F.array_distinct(F.concat(*[of_kind(*form) for form in longer])),
            "bare": F.array_distinct(of_kind(*section)),
        },
    )
    free = F.filter("bare", lambda b: ~F.exists("longer", lambda a: F.endswith(a["reference"], b["reference"])))
    return found.select(row_id, F.inline(F.concat("longer", free)))


def docket_year(reference: Column, pivot: int) -> Column:
    """Four-digit year of a docket reference; two digits below `pivot` belong to this century."""
    year = F.regexp_extract(reference, r"^(?:[0-9]:|Nos?\. )([0-9]{2})-", 1).try_cast("int")
    return F.when(year < pivot, year + 2000).otherwise(year + 1900)


def intake(incoming: DataFrame, stored: DataFrame, row_id: str, text: str, chunk_size: int = 8192) -> DataFrame:
    """Contents that the store lacks, one row each: digest, copies, chunks, and entities found.

    The stages only compose lazy DataFrames: identify, keep what is new, chunk and extract. Everything
    after the first stage runs on one row per new content.
    """
    fresh = new_content(incoming, stored, row_id, F.col(text)).withColumnRenamed("first_id", row_id)
    # only rows that are first of a new content are read for words and entities
    incoming = incoming.join(fresh.select(row_id), row_id, "left_semi")
    chunks = F.ceil(F.octet_length(F.col(text)) / chunk_size).cast("bigint")
    entities = F.size(T.matches(F.col(text), T.EMAIL)) + F.size(T.matches(F.col(text), T.PHONE))
    described = incoming.select(
        row_id, chunks.alias("n_chunks"), T.word_count(F.col(text)).alias("n_words"), entities.alias("n_entities")
    )
    return fresh.join(described, row_id)


def first_by_precedence(found: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """One row per key: the one from the extractor with the lowest rank.

    `min_by` merges on the map side, so a value repeated without end needs no window partition.
    """
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(rank)).alias("__row")).select(*keys, "__row.*")
