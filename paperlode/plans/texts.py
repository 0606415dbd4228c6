"""Extraction, masking, sections and fuzzy names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions import text as T
from paperlode.operators import documents as D
from paperlode.operators import similarity as S
from paperlode.plans.registry import Tables, query


def _gaps(column: str, pattern: str) -> str:
    return f"regexp_split_to_array({column}, '{pattern}')"


def _all(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({column}, '{pattern}', {group})"


@query(f"""
SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS n_words,
  array_to_string(list_sort(list_distinct({_all("text", T.EMAIL)})), ',') AS emails,
  array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS phones,
  regexp_matches(text, '{T.SSN_SHAPE}') AS has_ssn_shape
FROM (SELECT *, list_transform({_all("text", T.PHONE)}, lambda m: regexp_replace(m, '{T.PHONE_PARTS}', '(\\1) \\2-\\3')) AS v FROM documents)""")
def text_records(t: Tables) -> DataFrame:
    found = D.text_records(t.documents, "doc_id", "text")
    return found.withColumn("emails", F.array_join("emails", ",")).withColumn("phones", F.array_join("phones", ","))


def _spans_sql(kind: str, pattern: str) -> str:
    return f"""
SELECT doc_id, '{kind}' AS kind, start, value,
  regexp_replace(substring(text, greatest(start - 50, 1), start + length(value) + 50 - greatest(start - 50, 1)), '[\\r\\n]', ' ', 'g') AS context
FROM (SELECT doc_id, text, m[i] AS value,
        (1 + list_sum(list_transform(g[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT doc_id, text, {_gaps("text", pattern)} AS g, {_all("text", pattern)} AS m FROM documents)))"""


@query(_spans_sql("email", T.EMAIL) + " UNION ALL " + _spans_sql("phone", T.PHONE))
def entity_spans(t: Tables) -> DataFrame:
    return D.found_spans(t.documents, "doc_id", "text", {"email": T.EMAIL, "phone": T.PHONE})


_FIRST_SEEN = "list_filter(v, lambda x, i: list_position(v, x) = i)"


@query(f"""
WITH f AS (SELECT doc_id, text, list_concat({_all("text", T.EMAIL)}, {_all("text", T.PHONE)}) AS v FROM documents),
d AS (SELECT doc_id, text, {_FIRST_SEEN} AS u FROM f),
k AS (SELECT doc_id, text, list_sort(list_transform(u, lambda x, i: {{'n': -length(x), 'v': x, 't': '[[ENTITY-' || i || ']]'}})) AS e FROM d)
SELECT doc_id, len(e) AS n_masked, sha256(list_reduce(list_prepend({{'n': 0, 'v': text, 't': ''}}, e),
  lambda a, x: {{'n': 0, 'v': replace(a.v, x.v, x.t), 't': ''}}).v) AS masked_hash FROM k""")
def masked_documents(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", "text", T.mask_table(F.col("text")).alias("entities"))
    return keyed.select(
        "doc_id",
        F.size("entities").alias("n_masked"),
        F.sha2(T.mask(F.col("text"), F.col("entities")), 256).alias("masked_hash"),
    )


_MEMO_SQL = """memo AS (SELECT o_orderkey, 'PO' || lpad(o_orderkey::VARCHAR, 8, '0') || ' placed ' || strftime(o_orderdate, '%Y-%m-%d')
  || ', seen ' || month(o_orderdate) || '/' || (day(o_orderdate) + 3) || '/' || year(o_orderdate)
  || '. Due: $' || o_totalprice::DECIMAL(18,2) || ' or USD ' || (o_totalprice::DECIMAL(18,2) + 1) || ' net' AS text FROM orders)"""


def _memos(t: Tables) -> DataFrame:
    """A sentence per order, so that the date and amount extractors meet real values (and impossible days)."""
    day, price = F.col("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)")
    return t.orders.select(
        "o_orderkey",
        F.concat(
            F.lit("PO"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"),
            F.lit(" placed "), F.substring(day.cast("string"), 1, 10),
            F.lit(", seen "), F.month(day).cast("string"), F.lit("/"), (F.dayofmonth(day) + 3).cast("string"),
            F.lit("/"), F.year(day).cast("string"),
            F.lit(". Due: $"), price.cast("string"), F.lit(" or USD "), (price + 1).cast("string"), F.lit(" net"),
        ).alias("text"),
    )


@query(f"""
WITH {_MEMO_SQL},
c AS (SELECT o_orderkey, 0 AS rank, 'iso' AS form, try_strptime(unnest({_all("text", T.ISO_DATE)}), '%Y-%m-%d') AS day FROM memo
  UNION ALL SELECT o_orderkey, 1, 'us', try_strptime(unnest({_all("text", T.US_DATE)}), '%m/%d/%Y') FROM memo)
SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day, min_by(form, rank) AS form FROM c WHERE day IS NOT NULL GROUP BY ALL""")
def memo_dates(t: Tables) -> DataFrame:
    found = D.found_dates(_memos(t), "o_orderkey", "text")
    return found.select("o_orderkey", F.col("day").cast("string").alias("day"), "form")


@query(f"""
WITH {_MEMO_SQL},
a AS (SELECT o_orderkey, strpos(text, '$') AS start, regexp_extract(text, '{T.DOLLARS}', 1) AS raw FROM memo
  UNION ALL SELECT o_orderkey, strpos(text, 'USD'), regexp_extract(text, '{T.USD_BEFORE}', 1) FROM memo)
SELECT o_orderkey, start, raw::DECIMAL(18,2)::VARCHAR AS amount FROM a""")
def memo_amounts(t: Tables) -> DataFrame:
    found = D.found_amounts(_memos(t), "o_orderkey", "text")
    return found.select("o_orderkey", "start", F.col("amount").cast("string").alias("amount"))


@query(f"""WITH {_MEMO_SQL} SELECT o_orderkey, 'PO' || lpad(o_orderkey::VARCHAR, 8, '0') AS serial FROM memo""")
def memo_serials(t: Tables) -> DataFrame:
    return D.serial_ids(_memos(t), "o_orderkey", "text", ("USD", "NO"))


@query(f"""
WITH f AS (SELECT doc_id, unnest({_all("text", T.EMAIL)}) AS value, 'email' AS kind, 0 AS rank FROM documents
  UNION ALL SELECT doc_id, unnest({_all("text", r"[A-Za-z0-9.-]+@[A-Za-z0-9.-]+")}), 'address', 1 FROM documents
  UNION ALL SELECT doc_id, unnest({_all("text", T.PHONE)}), 'phone', 2 FROM documents)
SELECT doc_id, value, min_by(kind, rank) AS kind FROM f GROUP BY doc_id, value""")
def merged_extractors(t: Tables) -> DataFrame:
    """A strict and a loose extractor may find the same value; the strict one names it."""
    extractors = [("email", T.EMAIL), ("address", r"[A-Za-z0-9.-]+@[A-Za-z0-9.-]+"), ("phone", T.PHONE)]
    return D.merged_finds(t.documents, "doc_id", "text", extractors)


_DECODED = r"""replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'),
  '&amp;', '&'), '&amp', '&')"""
_PLAIN = rf"trim(regexp_replace({_DECODED}, '[ \t\r\n]+', ' ', 'g'), ' ')"


@query(rf"""
WITH m AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?is){"|".join(D.UNSEEN)}', ' ', 'g'), '{D.HEADING}') AS p FROM pages),
s AS (SELECT page_id, unnest(p) AS piece, unnest(range(0, len(p))) AS section_no FROM m),
c AS (SELECT page_id, section_no::INT AS section_no,
    CASE WHEN section_no > 0 THEN {_PLAIN.format("regexp_extract(piece, '(?is)^(.*?)</h[1-6]\s*>', 1)")} END AS title,
    {_PLAIN.format("CASE WHEN section_no > 0 THEN regexp_replace(piece, '(?is)^.*?</h[1-6]\s*>', '') ELSE piece END")} AS body FROM s)
SELECT * FROM c WHERE body <> ''""")
def page_sections(t: Tables) -> DataFrame:
    return D.html_sections(t.pages, "page_id", "html")


@query(r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM pages)
SELECT page_id, CASE WHEN scheme = 'mailto' THEN 'email' WHEN scheme = 'tel' THEN 'call' WHEN scheme = 'sms' THEN 'message'
  WHEN ext IN ('html', 'htm') THEN 'page' WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'eml' THEN 'email' WHEN ext = 'txt' THEN 'text'
  WHEN ext = 'docx' THEN 'document' ELSE 'file' END AS doc_type FROM u""")
def page_types(t: Tables) -> DataFrame:
    return t.pages.select("page_id", D.document_type(F.col("url")).alias("doc_type"))


def _grams(name: str) -> str:
    key = f"regexp_replace(regexp_replace(lower({name}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')"
    return (
        f"list_distinct(flatten(list_transform(list_filter(string_split({key}, ' '), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
    )


@query(f"""
WITH n AS (SELECT p_name, count(*) AS n_rows FROM part GROUP BY p_name),
g AS (SELECT *, {_grams("p_name")} AS a, {_grams("'Small-Rings'")} AS b FROM n)
SELECT p_name, n_rows, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS similarity
FROM g ORDER BY similarity DESC, p_name LIMIT 15""")
def similar_part_names(t: Tables) -> DataFrame:
    return S.similar_names(t.part, "p_name", "Small-Rings", 15)


@query("""
SELECT p_name, count(*) AS n_rows, levenshtein(p_name, 'cold bolt') AS edits FROM part
WHERE levenshtein(p_name, 'cold bolt') <= 4 GROUP BY p_name""")
def near_spellings(t: Tables) -> DataFrame:
    return S.nearest_spellings(t.part, "p_name", "cold bolt", 4)


_DIGITS = "translate(upper(last), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000099')"
_SOUND = f"""(upper(substring(last, 1, 1)) || rpad(substring(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace({_DIGITS}, '9', ''), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g')
  [CASE WHEN substring({_DIGITS}, 1, 1) IN ('0', '9') THEN 1 + (substring({_DIGITS}, 1, 1) = '0')::INT ELSE 2 END:], '0', ''), ' ', ''), 1, 3), 3, '0'))"""


@query(f"""
WITH n AS (SELECT p_name, list_last(string_split(trim(lower(p_name)), ' ')) AS last, count(*) AS n_rows FROM part GROUP BY p_name)
SELECT {_SOUND} AS sound, count(*) AS n_names, sum(n_rows)::BIGINT AS n_rows FROM n GROUP BY 1""")
def sound_groups(t: Tables) -> DataFrame:
    return S.sound_groups(t.part, "p_name")


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, {_grams("name")} AS a FROM n),
p AS (SELECT l.name AS left_name, r.name AS right_name, round(len(list_intersect(l.a, r.a))
  / (len(l.a) + len(r.a) - len(list_intersect(l.a, r.a)))::DOUBLE, 6) AS similarity FROM g l JOIN g r ON l.name < r.name)
SELECT * FROM p WHERE similarity >= 0.4""")
def similar_name_pairs(t: Tables) -> DataFrame:
    return S.similarity_join(t.part, "p_name", 0.4)


_CITED_SQL = """cited AS (SELECT o_orderkey, 'See ' || (o_custkey % 50 + 1) || ' U.S.C. §§ ' || o_orderkey || ', and ' || (o_custkey % 900 + 1)
  || ' F.3d ' || (o_orderkey % 5000) || '; § ' || o_orderkey || ' and § ' || (o_orderkey + 1) || ', No. 2:' || lpad((o_orderkey % 100)::VARCHAR, 2, '0')
  || '-cv-' || lpad((o_custkey % 1000)::VARCHAR, 5, '0') || '.' AS text FROM orders)"""


def _cited(t: Tables) -> DataFrame:
    """A sentence with citations per order, as the documents hold none."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey",
        F.format_string(
            "See %d U.S.C. §§ %d, and %d F.3d %d; § %d and § %d, No. 2:%02d-cv-%05d.",
            customer % 50 + 1, key, customer % 900 + 1, key % 5000, key, key + 1, key % 100, customer % 1000,
        ).alias("text"),
    )


@query(f"""
WITH {_CITED_SQL}
SELECT o_orderkey, regexp_extract(text, '[0-9]+ U[^,]*') .replace('§§', '§') AS reference, 'code' AS kind, NULL::INT AS year FROM cited
UNION ALL SELECT o_orderkey, regexp_extract(text, '[0-9]+ F.3d [0-9]+'), 'opinion', NULL FROM cited
UNION ALL SELECT o_orderkey, '§ ' || (o_orderkey + 1), 'section', NULL FROM cited
UNION ALL SELECT o_orderkey, regexp_extract(text, '2:[0-9]+-cv-[0-9]+'), 'docket',
  (o_orderkey % 100 + CASE WHEN o_orderkey % 100 < 70 THEN 2000 ELSE 1900 END)::INT FROM cited""")
def cited_references(t: Tables) -> DataFrame:
    found = D.legal_references(_cited(t), "o_orderkey", "text")
    return found.withColumn("year", F.when(F.col("kind") == "docket", D.docket_year(F.col("reference"), 70)))


@query(f"""
WITH stored AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents
  WHERE sha256(text) NOT IN (SELECT h FROM stored) GROUP BY 1)
SELECT doc_id, content_hash, n_copies, ((octet_length(encode(text)) + 8191) // 8192)::BIGINT AS n_chunks,
  len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS n_words, len({_all("text", T.EMAIL)}) + len({_all("text", T.PHONE)}) AS n_entities
FROM fresh JOIN documents USING (doc_id)""")
def intake(t: Tables) -> DataFrame:
    """Labelled documents count as stored; the others are identified, reduced to new contents and described."""
    stored = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return D.intake(t.documents, stored, "doc_id", "text")
