"""Files, models, streams, proofs and column functions, over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions import kinetics as K
from paperlode.functions import text as T
from paperlode.functions.geo import haversine_m
from paperlode.functions.hashing import canonical_json
from paperlode.functions.models import model_column
from paperlode.operators import documents as D
from paperlode.operators import integrity as I
from paperlode.operators import joins as J
from paperlode.operators import jobs as Q
from paperlode.operators import stats as S
from paperlode.plans.integrity import _payload
from paperlode.plans.registry import Tables, query
from paperlode.plans.texts import _MEMO_SQL, _memos
from paperlode.session import shared_dir
from paperlode.sources import files as FS
from paperlode.sources import messages as M
from paperlode.sources import paged as PG
from paperlode.sources.tables import SCHEMAS
from paperlode.streaming import ingest as SI


@query("""
SELECT p_size, sha256(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS digest, sum(strlen(p_name) + 1)::BIGINT AS n_bytes
FROM part GROUP BY p_size""")
def file_digests(t: Tables) -> DataFrame:
    """Names written as one file per size, read back as bytes."""
    path = shared_dir(t.spark, "names")
    sorted_names = t.part.repartition("p_size").sortWithinPartitions("p_size", "p_partkey").select("p_name", "p_size")
    sorted_names.write.partitionBy("p_size").text(path)
    size = F.regexp_extract("path", "p_size=([0-9]+)/", 1).cast("int").alias("p_size")
    return FS.read_bytes(t.spark, path, "*.txt").select(
        size, F.sha2("content", 256).alias("digest"), F.col("length").alias("n_bytes")
    )


@query("""
SELECT p_size, CASE WHEN p_size % 5 = 0 THEN 'missing' WHEN p_size % 3 = 0 THEN 'changed' ELSE 'ok' END AS state
FROM part GROUP BY p_size""")
def checked_digests(t: Tables) -> DataFrame:
    """Files of names by size against the digests of the table, of which some are wrong and some name no file."""
    path = shared_dir(t.spark, "names")
    size = F.col("p_size")
    few = t.part.where(size % 5 != 0).repartition("p_size").sortWithinPartitions("p_size", "p_partkey").select("p_name", "p_size")
    few.write.partitionBy("p_size").text(path)
    folder = F.regexp_extract("path", "p_size=([0-9]+)/", 1)
    files = FS.read_bytes(t.spark, path, "*.txt").withColumn("path", folder)
    # the names of one size make one file
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.concat(x["p_name"], F.lit("\n")))
    digest = F.sha2(F.concat(F.array_join(names, ""), F.when(size % 3 == 0, "more").otherwise("")), 256)
    expected = t.part.groupBy("p_size").agg(digest.alias("sha256")).select(size.cast("string").alias("path"), "sha256")
    return FS.check_digests(files, expected).select(F.col("path").cast("int").alias("p_size"), "state")


@query("""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, '1.1' AS part, 'text/plain' AS content_type, NULL AS filename, sha256(text) AS digest, strlen(text)::BIGINT AS n_bytes FROM m
UNION ALL SELECT conv_id, turn, '1.2', 'text/html', NULL, sha256('<p>é=' || role || '</p>'), strlen('<p>é=' || role || '</p>') - 1 FROM m
UNION ALL SELECT conv_id, turn, '2', 'text/plain', 'note ' || turn || '.txt', sha256(role || ' 日本'), 2 * length(role || ' 日本') FROM m
UNION ALL SELECT conv_id, turn, '3.1', 'text/plain', NULL, sha256('of ' || conv_id), length('of ' || conv_id) FROM m""")
def mime_message_parts(t: Tables) -> DataFrame:
    """Turns written as messages of nested parts, in three transfer encodings and character sets, taken apart again."""
    end = F.lit("\r\n")

    def lines(*parts) -> Column:
        return F.concat(*[x for p in parts for x in (F.lit(p) if isinstance(p, str) else p, end)])

    coded = lambda c, charset="UTF-8": F.base64(F.encode(c, charset))
    message = lines(
        "MIME-Version: 1.0", 'Content-Type: multipart/mixed; boundary="out"', "", "--out",
        'Content-Type: multipart/alternative; boundary="in"', "", "--in",
        "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: base64", "", coded(F.coalesce("text", F.lit(""))), "--in",
        "Content-Type: text/html; charset=iso-8859-1", "Content-Transfer-Encoding: quoted-printable", "",
        F.concat(F.lit("<p>=E9=3D="), end, "role", F.lit("</p>")), "--in--", "--out",
        "Content-Type: text/plain; charset=utf-16be", "Content-Transfer-Encoding: base64",
        F.concat(F.lit('Content-Disposition: attachment; filename="note '), F.col("turn").cast("string"), F.lit('.txt"')), "",
        coded(F.concat("role", F.lit(" 日本")), "UTF-16BE"), "--out", "Content-Type: message/rfc822", "",
        "Subject: inner", "", F.concat(F.lit("of "), F.col("conv_id").cast("string")), "--out--",
    )
    raw = t.conversations.select(F.struct("conv_id", "turn").alias("id"), F.encode(message, "UTF-8").alias("raw"))
    return M.mime_parts(raw, "id", "raw").select(
        "id.conv_id", "id.turn", "part", "content_type", "filename", F.sha2("text", 256).alias("digest"), "n_bytes"
    )


PAGED = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


def _pages(t: Tables, numbers: range) -> str:
    """Orders written as pages of records, twenty in all, of which those of `numbers`."""
    path = shared_dir(t.spark, "pages")
    item = F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    page = F.pmod("o_orderkey", F.lit(20)).alias("page")
    rows = t.orders.where(page.isin(list(numbers))).select(page, F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    rows.repartition("page").write.partitionBy("page").text(path)
    return "file://" + path if path.startswith("/") else path


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def paged_orders(t: Tables) -> DataFrame:
    """Orders read from numbered pages."""
    PG.register(t.spark)
    return t.spark.read.format(PG.NAME).schema(PAGED).option("pagesPerPartition", 3).load(_pages(t, range(20)))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 20 >= 5")
def paged_order_stream(t: Tables) -> DataFrame:
    """The same pages as a stream, of which the first five are missing."""
    PG.register(t.spark)
    stream = t.spark.readStream.format(PG.NAME).schema(PAGED).load(_pages(t, range(5, 20)))
    path = shared_dir(t.spark, "paged-stream")
    SI.run_to_table(stream, path).awaitTermination()
    return t.spark.read.schema(PAGED).parquet(f"{path}/data")


@query("""
SELECT c_nationkey AS nation, count(*) AS customers, [min(c_mktsegment), max(c_mktsegment)]::VARCHAR AS segments
FROM customer GROUP BY c_nationkey""")
def json_documents(t: Tables) -> DataFrame:
    """One JSON document a file, written and read with a declared schema."""
    path = shared_dir(t.spark, "json-documents")
    per = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("customers"), F.array(F.min("c_mktsegment"), F.max("c_mktsegment")).alias("segments")
    )
    body = F.to_json(F.struct("nation", F.struct("customers", "segments").alias("held")), {"pretty": "true"})
    per.select(body.alias("value"), "nation").repartition("nation").write.partitionBy("nation").text(path)
    schema = "nation int, held struct<customers: bigint, segments: array<string>>"
    found = FS.read_json(t.spark, f"{path}/*", schema)
    listed = F.concat(F.lit("["), F.array_join("held.segments", ", "), F.lit("]"))
    return found.select("nation", "held.customers", listed.alias("segments"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders")
def json_lines(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "json-lines")
    FS.write_json(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    read = t.spark.read.schema(schema).json(path)
    return read.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("total"))


@query("""
WITH p AS (SELECT c_custkey, c_custkey % 181 - 90 AS a, c_custkey * 7 % 361 - 180 AS b, n_nationkey * 7 - 84 AS c, n_nationkey * 14 - 168 AS d
           FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, round(2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0, sin(radians(c - a) / 2) ** 2
  + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2))), 1) AS metres FROM p""")
def customer_distances(t: Tables) -> DataFrame:
    """Distance of a point made from the customer's key to one made from the nation's; the tables have no places."""
    customer, nation = t.customer, t.nation
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    key, home = F.col("c_custkey"), F.col("n_nationkey")
    metres = haversine_m(key % 181 - 90, key * 7 % 361 - 180, home * 7 - 84, home * 14 - 168)
    return joined.select("c_custkey", F.round(metres, 1).alias("metres"))


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity AS m, CASE WHEN l_quantity > 0 AND l_linenumber > 0 AND l_tax > 0
    THEN l_extendedprice / (l_quantity * l_linenumber) * exp(-ln(2) * (l_discount * 100) / (l_tax * 100)) END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN x > 0 THEN m / x END, 9) AS ratio,
  CASE WHEN x > 0 THEN m / x BETWEEN 0.01 AND 0.1 END AS in_range FROM e""")
def level_checks(t: Tables) -> DataFrame:
    """The level formula over numbers of order lines; lines without tax have no half-life and no verdict."""
    level = K.expected_level(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax") * 100,
                             F.col("l_discount") * 100)
    checked = K.level_ratio(F.col("l_quantity"), level, 0.01, 0.1)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", checked.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", F.round("c.ratio", 9).alias("ratio"), F.col("c.in_range").alias("in_range"))


@query("""
SELECT p_partkey, (length(p_name) - length(regexp_replace(p_name, '[aeiou]', '', 'g')))::INT AS vowels FROM part""")
def modelled_names(t: Tables) -> DataFrame:
    """A model behind the plug point: here one that counts vowels, so that SQL can tell what it must return."""
    count = model_column(lambda: lambda names: names.str.count("[aeiou]"), "int")
    return t.part.select("p_partkey", count(F.col("p_name")).alias("vowels"))


def _distance_sql(a: str, b: str) -> str:
    places = f"greatest(len({a}), len({b}))"
    return (
        f"CASE WHEN {places} > 0 THEN len(list_filter(range(1, {places} + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i])) "
        f"/ {places}::DOUBLE ELSE 0 END"
    )


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"""
WITH r AS (SELECT p_partkey, {_TOKENS.format("p_name")} AS a, {_TOKENS.format("p_type")} AS b, {_TOKENS.format("p_brand")} AS c FROM part)
SELECT p_partkey, round(greatest({_distance_sql("a", "b")}, {_distance_sql("a", "c")}, {_distance_sql("b", "c")}), 9) AS widest FROM r""")
def widest_differences(t: Tables) -> DataFrame:
    """Three token runs of a part, compared pairwise inside the row."""
    runs = F.array(*[T.tokens(F.col(c)) for c in ("p_name", "p_type", "p_brand")])
    return t.part.select("p_partkey", F.round(T.widest_difference(runs), 9).alias("widest"))


@query("""
WITH n AS (SELECT count(*) AS n FROM events)
SELECT unnest([0, n // 2, n - 1]) AS idx, true AS included, false AS other_included FROM n""")
def inclusion_proofs(t: Tables) -> DataFrame:
    """Paths of the first, a middle and the last event: each proves its own event and not the one beside it."""
    n = t.events.count()
    levels = I.merkle_levels(I.merkle_leaves(t.events, "event_id", _payload()), n, store=True)
    leaves, root = levels[0], bytes(levels[-1].first()["hash"])
    wanted = [0, n // 2, n - 1]
    proofs = [(i, I.audit_path(levels, i), root, n, i - 1 if i else 1) for i in wanted]
    schema = "idx bigint, path array<binary>, root binary, n bigint, beside bigint"
    rows = t.spark.createDataFrame(proofs, schema)
    own = leaves.withColumnRenamed("hash", "leaf")
    other = leaves.select(F.col("idx").alias("beside"), F.col("hash").alias("other"))
    # three rows ask, so they are what goes to the leaves
    asked = other.join(F.broadcast(own.join(F.broadcast(rows), "idx")), "beside")

    def proven(leaf: str):
        return I.included(F.col(leaf), F.col("idx"), F.col("n"), F.col("path"), F.col("root"))

    return asked.select("idx", proven("leaf").alias("included"), proven("other").alias("other_included"))


@query("""
SELECT count(*) AS n_rows, true AS size_ok, true AS root_ok FROM events
UNION ALL SELECT count(*), false, false FROM events WHERE event_id < (SELECT max(event_id) FROM events)""")
def sealed_events(t: Tables) -> DataFrame:
    """A seal over all events holds for them and not for a log whose last row was cut off."""
    sealed = I.seal(t.events, "event_id", _payload())
    last = t.events.agg(F.max("event_id")).first()[0]
    cut = t.events.where(F.col("event_id") < last)
    return S.union_all([I.matches_seal(df, "event_id", _payload(), sealed) for df in (t.events, cut)])


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def unmasked_documents(t: Tables) -> DataFrame:
    """Masking and its inverse give the text back."""
    keyed = t.documents.select("doc_id", "text", T.mask_table(F.col("text")).alias("e"))
    masked = keyed.select("doc_id", "e", T.mask(F.col("text"), F.col("e")).alias("masked"))
    return masked.select("doc_id", F.sha2(T.unmask(F.col("masked"), F.col("e")), 256).alias("text_hash"))


@query("SELECT DISTINCT user_id FROM events")
def streamed_users(t: Tables) -> DataFrame:
    """Events stream in, and the table stores one for each user."""
    path = shared_dir(t.spark, "stream-users")
    SI.ingest_new(SI.stream_table(t.spark, t.base, "events"), path, "user_id").awaitTermination()
    return t.spark.read.schema(SCHEMAS["events"]).parquet(f"{path}/data").select("user_id")


@query("SELECT DISTINCT user_id FROM events")
def watermarked_users(t: Tables) -> DataFrame:
    """The same by state that a watermark releases; the delay is longer than the events."""
    path = shared_dir(t.spark, "watermarked-users")
    stream = SI.first_seen(SI.stream_table(t.spark, t.base, "events"), ["user_id"], "ts", "36500 days")
    SI.run_to_table(stream, path).awaitTermination()
    return t.spark.read.schema(SCHEMAS["events"].replace("timestamp_ntz", "timestamp")).parquet(f"{path}/data").select("user_id")


_NEGATIONS = ", ".join(f"'{w}'" for w in T.NEGATIONS)


@query(f"""
SELECT conv_id, turn, len(list_filter(regexp_extract_all(regexp_replace(lower(text), 'n[’'']t', ' not', 'g'), '[a-z0-9]+'),
  lambda w: list_contains([{_NEGATIONS}], w))) % 2 = 1 AS negated FROM conversations""")
def negated_turns(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.is_negated(F.col("text")).alias("negated"))


@query(f"""
WITH n AS (SELECT source, len(list_filter(regexp_extract_all(regexp_replace(lower(text), 'n[’'']t', ' not', 'g'), '[a-z0-9]+'),
  lambda w: list_contains([{_NEGATIONS}], w))) % 2 = 1 AS negated FROM documents)
SELECT source, count(*) FILTER (WHERE NOT negated) AS n_affirmed, count(*) FILTER (WHERE negated) AS n_denied FROM n
GROUP BY source HAVING n_affirmed > 0 AND n_denied > 0""")
def polarity_conflicts(t: Tables) -> DataFrame:
    """Sources that hold texts with and without a negation."""
    return S.polarity_conflicts(t.documents, "source", "text")


@query("""
WITH v AS (SELECT source, lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY ALL),
s AS (SELECT source, count(DISTINCT doc_id) AS n_sources FROM documents GROUP BY source)
SELECT source, n_sources, count(*) AS n_values FROM v JOIN s USING (source) GROUP BY source, n_sources HAVING max(n) < n_sources""")
def language_conflicts(t: Tables) -> DataFrame:
    """Sources whose documents do not agree on a language."""
    return S.value_conflicts(t.documents.select("doc_id", "source", "lang"), "source", "doc_id", "lang")


@query("""
SELECT event_id, '{"a":' || (event_id * 100) || ',"b":{"a":' || user_id || '.5,"y":"' || event_type || '"},"z":['
  || event_id || ',true,null]}' AS canonical FROM events""")
def canonical_nested(t: Tables) -> DataFrame:
    """Objects built from several columns with keys out of order and numbers in several forms."""
    raw = F.concat(
        F.lit('{"z": ['), F.col("event_id").cast("string"), F.lit(', true, null ], "b" : {"y": "'), "event_type",
        F.lit('", "a": '), F.col("user_id").cast("string"), F.lit('.50}, "a": '), F.col("event_id").cast("string"), F.lit("e2}"),
    )
    return t.events.select("event_id", canonical_json(raw).alias("canonical"))


@query("""
WITH a AS (SELECT o_orderstatus, o_orderdate, coalesce(n, 0) AS attempts FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT CASE WHEN attempts >= 5 THEN 'dead' ELSE 'queued' END AS new_state, count(*) AS n FROM a
WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1""")
def swept_counts(t: Tables) -> DataFrame:
    """How many stuck orders a sweep changes, by outcome."""
    tries = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    jobs = t.orders.join(tries, "o_orderkey", "left").withColumn("attempts", F.coalesce("n", F.lit(0)))
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    swept = Q.sweep_stale(jobs, stale, F.col("attempts"), 5, "new_state").where("new_state IS NOT NULL")
    return swept.groupBy("new_state").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'click'),
m AS (SELECT p.event_id AS id, c.event_id AS r, abs(epoch_us(p.ts) - epoch_us(c.ts)) AS apart FROM p JOIN c
  ON c.user_id = p.user_id AND abs(epoch_us(p.ts) - epoch_us(c.ts)) <= 86400000000 AND abs(p.value - c.value) <= 5),
b AS (SELECT id, count(*) AS n, min({'apart': apart, 'r': r}).r AS nearest FROM m GROUP BY id)
SELECT event_id, coalesce(n, 0) AS n_matches, nearest FROM p LEFT JOIN b ON id = event_id""")
def correlated_purchases(t: Tables) -> DataFrame:
    """Purchases with the clicks of the same user within a day and of about the same value."""
    events = t.events.select("event_id", "user_id", "ts", "value", "event_type")
    purchases, clicks = events.where("event_type = 'purchase'"), events.where("event_type = 'click'")
    return J.correlated(purchases, clicks, ["user_id"], "ts", "value", "event_id", "event_id", 86_400, 5.0)


@query("""
SELECT conv_id, turn, role AS "from", 'turn ' || turn || ' of ' || conv_id AS subject, sha256(text) AS body_hash FROM conversations""")
def message_parts(t: Tables) -> DataFrame:
    """Turns as mail messages with a folded subject, taken apart again."""
    raw = F.concat(
        F.lit("From: "), "role", F.lit("\r\nSubject: turn "), F.col("turn").cast("string"), F.lit("\r\n of "),
        F.col("conv_id").cast("string"), F.lit("\r\nSubject: second\r\n\r\n"), "text",
    )
    messages = t.conversations.select(F.struct("conv_id", "turn").alias("id"), raw.alias("message"))
    parts = D.email_parts(messages, "id", "message", ["From", "Subject"])
    return parts.select("id.conv_id", "id.turn", "from", "subject", F.sha2("body", 256).alias("body_hash"))


@query(f"""
WITH {_MEMO_SQL},
i AS (SELECT o_orderkey, unnest(regexp_extract_all(text, '{T.ISO_DATE}')) AS value FROM memo),
u AS (SELECT o_orderkey, unnest(regexp_extract_all(text, '{T.US_DATE}')) AS value FROM memo)
SELECT o_orderkey, value, try_strptime(value, '%Y-%m-%d') IS NOT NULL AS possible FROM i
UNION ALL SELECT o_orderkey, value, try_strptime(value, '%m/%d/%Y') IS NOT NULL FROM u""")
def memo_date_flags(t: Tables) -> DataFrame:
    return D.date_flags(_memos(t), "o_orderkey", "text")


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '0') AS bar_number FROM customer")
def bar_numbers(t: Tables) -> DataFrame:
    """A signature per customer, as the documents hold none; a longer number beside it must not count."""
    line = F.format_string("/s/ %s (State Bar No. %06d), Bar No. 1234567890", "c_name", "c_custkey")
    found = t.customer.select("c_custkey", T.bar_numbers(line).alias("numbers"))
    return found.select("c_custkey", F.explode("numbers").alias("bar_number"))


@query("""
SELECT c_custkey, 'Paid by [[ENTITY-1]] of ' || n_name || ' through [[ENTITY-2]]' AS masked, c_custkey % 2 = 0 AS depends
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def masked_names(t: Tables) -> DataFrame:
    """Known names are masked, one of two statements about each text depends on a masked value."""
    customer, nation = t.customer, t.nation
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    agent = F.concat(F.lit("Agent "), F.col("c_custkey").cast("string"))
    text = F.concat(F.lit("Paid by "), "c_name", F.lit(" of "), "n_name", F.lit(" through "), agent)
    keyed = joined.select("c_custkey", text.alias("text"), T.mask_table(text, F.array("c_name", agent, F.lit("absent"))).alias("e"))
    statement = F.when(F.col("c_custkey") % 2 == 0, "[[ENTITY-2]] paid").otherwise("someone paid")
    return keyed.select("c_custkey", T.mask(F.col("text"), F.col("e")).alias("masked"),
                        T.depends_on_masked(statement, F.col("e")).alias("depends"))
