"""Counts, coverage, votes, audits and queue upkeep over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions.text import EMAIL, matches
from paperlode.operators import documents as D
from paperlode.operators import jobs as Q
from paperlode.operators import stats as S
from paperlode.operators.blocks import tasks_for
from paperlode.plans.registry import Tables, query
from paperlode.sources.tables import SCHEMAS

# Fixed value: order priorities from most to least urgent.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PRIORITY_SQL = "list_position([" + ", ".join(f"'{p}'" for p in PRIORITIES) + "], o_orderpriority) - 1"


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in SCHEMAS))
def table_counts(t: Tables) -> DataFrame:
    return S.row_counts({name: getattr(t, name) for name in SCHEMAS})


_KEYS = {
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "part": ["p_name"],
}


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(DISTINCT ({', '.join(k)})) AS n_keys, "
        f"count(*) = count(DISTINCT ({', '.join(k)})) AS is_unique FROM {n}"
        for n, k in _KEYS.items()
    )
)
def key_uniqueness(t: Tables) -> DataFrame:
    return S.key_uniqueness({name: (getattr(t, name), keys) for name, keys in _KEYS.items()})


@query("""
SELECT 'both' AS side, doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels)""")
def labelled_and_not(t: Tables) -> DataFrame:
    english, labelled = t.documents.where("lang = 'en'").select("doc_id"), t.labels.select("doc_id")
    both = english.intersect(labelled).select(F.lit("both").alias("side"), "doc_id")
    return both.unionByName(english.subtract(labelled).select(F.lit("unlabelled").alias("side"), "doc_id"))


@query(r"""
WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT 'lang' AS facet, lang AS value FROM d UNION ALL SELECT 'source', source FROM d
  UNION ALL SELECT 'quality', quality::VARCHAR FROM d UNION ALL SELECT 'toxic', toxic::VARCHAR FROM d)
SELECT facet, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY facet, value""")
def coverage_counts(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    return S.facet_counts(joined, {name: F.col(name) for name in ("lang", "source", "quality", "toxic")})


@query(r"""SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, count(*) AS n FROM pages GROUP BY 1""")
def pages_by_scheme(t: Tables) -> DataFrame:
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return t.pages.groupBy(scheme.alias("scheme")).agg(F.count("*").alias("n"))


@query("""
SELECT source FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source
HAVING count(*) FILTER (WHERE l.toxic = 1 AND d.lang = 'fr') = 0""")
def sources_without_toxic_french(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    return S.groups_without(joined, "source", (F.col("toxic") == 1) & (F.col("lang") == "fr"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL),
b AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY votes DESC) AS place FROM c)
SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) ELSE 'tie' END AS winner, max(votes) AS votes
FROM b WHERE place = 1 GROUP BY user_id""")
def commonest_event(t: Tables) -> DataFrame:
    return S.plurality(t.events, "user_id", "event_type")


@query("""
SELECT source, count(quality) AS n_checked, round(coalesce(avg(quality), 0.5), 6) AS rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def quality_rate(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return S.rate_by(joined, "source", F.col("quality") == 1)


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, min(turn) AS lo, max(turn) AS hi, count(DISTINCT turn) AS d,
    count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS replies,
    min_by(role, turn) AS opener FROM conversations GROUP BY conv_id),
r AS (SELECT 'starts_at_zero' AS rule, lo = 0 AS ok FROM c
  UNION ALL SELECT 'no_gap', hi - lo + 1 = d FROM c
  UNION ALL SELECT 'no_repeat', n = d FROM c
  UNION ALL SELECT 'user_opens', CASE WHEN opener <> 'system' THEN opener = 'user' END FROM c
  UNION ALL SELECT 'all_answered', users <= replies FROM c)
SELECT rule, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok IS NULL) AS unknown
FROM r GROUP BY rule""")
def conversation_audit(t: Tables) -> DataFrame:
    """Rules on the order of turns, from one aggregate row per conversation (no window over its turns)."""
    # The inner grouping merges repeats of a turn first, so a hot conversation is never one large group.
    turns = t.conversations.groupBy("conv_id", "turn").agg(
        F.count("*").alias("k"),
        F.count_if(F.col("role") == "user").alias("u"),
        F.count_if(F.col("role") == "assistant").alias("a"),
        F.min("role").alias("role"),
    )
    per = turns.groupBy("conv_id").agg(
        F.sum("k").alias("n"),
        F.count("*").alias("d"),
        F.min("turn").alias("lo"),
        F.max("turn").alias("hi"),
        F.sum("u").alias("users"),
        F.sum("a").alias("replies"),
        F.min_by("role", "turn").alias("opener"),
    )
    return S.rule_tallies(
        per,
        {
            "starts_at_zero": F.col("lo") == 0,
            "no_gap": F.col("hi") - F.col("lo") + 1 == F.col("d"),
            "no_repeat": F.col("n") == F.col("d"),
            "user_opens": F.when(F.col("opener") != "system", F.col("opener") == "user"),
            "all_answered": F.col("users") <= F.col("replies"),
        },
    )


@query("""
WITH r AS (SELECT 'order_key' AS rule, o_orderkey IS NOT NULL AS ok FROM orders
  UNION ALL SELECT 'known_status', o_orderstatus IN ('F', 'O', 'P') FROM orders
  UNION ALL SELECT 'known_priority', o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') FROM orders
  UNION ALL SELECT 'customer_name', regexp_matches(c_name, '^Customer#[0-9]{9}$') FROM customer
  UNION ALL SELECT 'positive_balance', c_acctbal > 0 FROM customer
  UNION ALL SELECT 'counted_length', n_chars = length(text) FROM documents
  UNION ALL SELECT 'shipped_after_order', l_shipdate >= o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT rule, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok IS NULL) AS unknown
FROM r GROUP BY rule""")
def table_checks(t: Tables) -> DataFrame:
    """Vocabulary, format, arithmetic and cross-table checks, as CHECK constraints would state them."""
    lines, orders = t.lineitem.select("l_orderkey", "l_shipdate"), t.orders
    shipped = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.union_all(
        [
            S.rule_tallies(
                orders,
                {
                    "order_key": F.col("o_orderkey").isNotNull(),
                    "known_status": F.col("o_orderstatus").isin("F", "O", "P"),
                    "known_priority": F.col("o_orderpriority").isin(*PRIORITIES[:4]),
                },
            ),
            S.rule_tallies(
                t.customer,
                {
                    "customer_name": F.col("c_name").rlike("^Customer#[0-9]{9}$"),
                    "positive_balance": F.col("c_acctbal") > 0,
                },
            ),
            S.rule_tallies(t.documents, {"counted_length": F.col("n_chars") == F.length("text")}),
            S.rule_tallies(shipped, {"shipped_after_order": F.col("l_shipdate") >= F.col("o_orderdate")}),
        ]
    )


@query(f"""
WITH f AS (SELECT DISTINCT doc_id, source, lang, unnest(regexp_extract_all(text, '{EMAIL}')) AS entity FROM documents),
v AS (SELECT entity, lang, count(DISTINCT doc_id) AS n FROM f GROUP BY ALL),
s AS (SELECT entity, count(DISTINCT doc_id) AS n_sources FROM f GROUP BY entity)
SELECT entity, n_sources, count(*) AS n_values FROM v JOIN s USING (entity) GROUP BY entity, n_sources HAVING max(n) < n_sources""")
def address_conflicts(t: Tables) -> DataFrame:
    """Addresses whose documents do not agree on a language."""
    found = t.documents.select("doc_id", "lang", F.explode(matches(F.col("text"), EMAIL)).alias("entity"))
    return S.value_conflicts(found, "entity", "doc_id", "lang")


@query("""
WITH f AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 200000),
v AS (SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderkey) AS n FROM f GROUP BY ALL),
s AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n_sources FROM f GROUP BY ALL)
SELECT o_custkey, n_sources, count(*) AS n_values FROM v JOIN s USING (o_custkey) GROUP BY o_custkey, n_sources HAVING max(n) < n_sources""")
def priority_conflicts(t: Tables) -> DataFrame:
    """Customers whose large orders do not agree on a priority."""
    large = t.orders.where("o_totalprice > 200000")
    return S.value_conflicts(large, "o_custkey", "o_orderkey", "o_orderpriority")


@query("""
WITH l AS (SELECT o_custkey, l_suppkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT o_custkey, l_suppkey, count(DISTINCT l_orderkey) AS n FROM l GROUP BY ALL),
s AS (SELECT o_custkey, count(DISTINCT l_orderkey) AS n_sources FROM l GROUP BY ALL)
SELECT o_custkey, n_sources, count(*) AS n_values FROM v JOIN s USING (o_custkey) GROUP BY o_custkey, n_sources HAVING max(n) < n_sources""")
def supplier_conflicts(t: Tables) -> DataFrame:
    """Customers whose orders share no supplier."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    placed = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    # dealt by rows: narrow rows that compress well make tasks of few bytes but many rows
    n = tasks_for(t.spark, lines.count())
    lines, placed = lines.repartition(n, "l_orderkey"), placed.repartition(n, "l_orderkey")
    return S.value_conflicts(lines.join(placed, "l_orderkey"), "o_custkey", "l_orderkey", "l_suppkey")


@query(f"""
SELECT o_orderkey, o_orderpriority, {_PRIORITY_SQL} AS place FROM orders WHERE o_orderstatus = 'O'
ORDER BY place NULLS LAST, o_orderdate, o_orderkey LIMIT 10""")
def next_orders(t: Tables) -> DataFrame:
    waiting = t.orders.where("o_orderstatus = 'O'").withColumn("place", Q.ordinal(F.col("o_orderpriority"), PRIORITIES))
    order = [F.asc_nulls_last("place"), F.asc("o_orderdate"), F.asc("o_orderkey")]
    return Q.next_jobs(waiting, order, 10).select("o_orderkey", "o_orderpriority", "place")


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderdate, coalesce(n, 0) AS attempts FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT o_orderkey, attempts, CASE WHEN attempts >= 5 THEN 'dead' ELSE 'queued' END AS new_state FROM a
WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01'""")
def swept_orders(t: Tables) -> DataFrame:
    """Orders stuck in processing since 1996 or before; the line count stands for their attempts."""
    tries = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    jobs = t.orders.join(tries, "o_orderkey", "left").withColumn("attempts", F.coalesce("n", F.lit(0)))
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    swept = Q.sweep_stale(jobs, stale, F.col("attempts"), 5, "new_state")
    return swept.where("new_state IS NOT NULL").select("o_orderkey", "attempts", "new_state")


@query(r"""
WITH u AS (SELECT lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM pages)
SELECT CASE WHEN ext IN ('html', 'htm') THEN 'page' WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'eml' THEN 'email'
  WHEN ext = 'txt' THEN 'text' WHEN ext = 'docx' THEN 'document' ELSE 'file' END AS doc_type, count(*) AS n FROM u GROUP BY 1""")
def pages_by_type(t: Tables) -> DataFrame:
    return t.pages.groupBy(D.document_type(F.col("url")).alias("doc_type")).agg(F.count("*").alias("n"))
