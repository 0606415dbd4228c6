"""Views, joins, predicates and row visibility over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperlode.functions.times import epoch_micros, still_valid
from paperlode.operators import access as A
from paperlode.operators import documents as D
from paperlode.operators import joins as J
from paperlode.operators import retrieval as R
from paperlode.operators import stats as S
from paperlode.operators import traversal as T
from paperlode.plans.registry import Tables, query


@query("""
SELECT 'message' AS kind, conv_id AS thread_id, turn, NULL::BIGINT AS doc_id, role AS party, coalesce(text, '') AS body
FROM conversations
UNION ALL
SELECT 'document', NULL, NULL, doc_id, source, coalesce(text, '') FROM documents""")
def communications(t: Tables) -> DataFrame:
    """Two kinds of text under one schema; columns a kind lacks are typed nulls."""
    nothing = F.lit(None).cast("bigint")
    body = F.coalesce(F.col("text"), F.lit("")).alias("body")
    messages = t.conversations.select(
        F.lit("message").alias("kind"), F.col("conv_id").alias("thread_id"), "turn", nothing.alias("doc_id"),
        F.col("role").alias("party"), body,
    )
    documents = t.documents.select(
        F.lit("document").alias("kind"), nothing.alias("thread_id"), nothing.alias("turn"), "doc_id",
        F.col("source").alias("party"), body,
    )
    return S.union_all([messages, documents])


@query("""
SELECT epoch_us(o_orderdate) AS at_us, 'order' AS kind, o_orderkey AS ref_id, o_orderpriority || ' ' || o_orderstatus AS summary,
  o_totalprice::DECIMAL(18,2)::VARCHAR AS amount FROM orders WHERE o_orderdate IS NOT NULL
UNION ALL
SELECT epoch_us(l_shipdate), 'shipment', l_orderkey, 'line ' || l_linenumber || ' ' || l_linestatus,
  l_extendedprice::DECIMAL(18,2)::VARCHAR FROM lineitem WHERE l_shipdate IS NOT NULL
UNION ALL
SELECT epoch_us(ts), event_type, event_id, props, value::DECIMAL(18,2)::VARCHAR FROM events WHERE ts IS NOT NULL""")
def timeline(t: Tables) -> DataFrame:
    """Everything dated, under one schema; a summary with a missing part is null, as SQL || gives it."""

    def branch(df: DataFrame, at: str, kind, ref: str, summary, amount: str) -> DataFrame:
        return df.where(F.col(at).isNotNull()).select(
            epoch_micros(F.col(at)).alias("at_us"),
            kind.alias("kind"),
            F.col(ref).alias("ref_id"),
            summary.alias("summary"),
            F.col(amount).cast("decimal(18,2)").cast("string").alias("amount"),
        )

    return S.union_all(
        [
            branch(
                t.orders, "o_orderdate", F.lit("order"), "o_orderkey",
                F.concat("o_orderpriority", F.lit(" "), "o_orderstatus"), "o_totalprice",
            ),
            branch(
                t.lineitem, "l_shipdate", F.lit("shipment"), "l_orderkey",
                F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" "), "l_linestatus"), "l_extendedprice",
            ),
            branch(t.events, "ts", F.col("event_type"), "event_id", F.col("props"), "value"),
        ]
    )


@query("""
SELECT c_custkey, o_orderkey, l_linenumber, l_partkey, s_name, n_name
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def lineage(t: Tables) -> DataFrame:
    """Customer to the nation of each supplier, keeping customers without orders and orders without lines."""
    orders = t.orders.select("o_orderkey", "o_custkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    steps = [(orders, "c_custkey", "o_custkey"), (lines, "o_orderkey", "l_orderkey")]
    filled = J.left_join_chain(t.customer.select("c_custkey"), steps)
    supplier, nation = t.supplier, t.nation
    return (
        filled.join(supplier, filled.l_suppkey == supplier.s_suppkey, "left")
        .join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
        .select("c_custkey", "o_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name")
    )


@query("""
SELECT l_orderkey, l_linenumber, p_name, s_name, n_name FROM lineitem
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE l_returnflag = 'R'""")
def returned_lines(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part, supplier, nation = t.part, t.supplier, t.nation
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name")
    )


@query("""
WITH c AS (SELECT doc_id, lang, source, hex(encode(text)) AS h FROM documents WHERE text <> '')
SELECT doc_id, lang, source, count(*) AS n_chunks, sum(least(8192, length(h) // 2 - i * 8192))::BIGINT AS n_bytes
FROM (SELECT *, unnest(range(0, (length(h) // 2 + 8191) // 8192)) AS i FROM c) GROUP BY doc_id, lang, source""")
def chunks_with_documents(t: Tables) -> DataFrame:
    """Chunks joined to their document's attributes; the chunk side is reduced before it is shuffled."""
    sizes = D.byte_chunks(t.documents, "doc_id", "text").groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum("byte_size").alias("n_bytes")
    )
    return sizes.join(t.documents.select("doc_id", "lang", "source"), "doc_id")


@query("""
SELECT p_brand, p_name AS surface_form, count(*) AS n_rows FROM part JOIN
  (SELECT p_brand, [min(p_name), max(p_name)] AS aliases FROM part GROUP BY p_brand) USING (p_brand)
WHERE NOT list_contains(aliases, p_name) GROUP BY p_brand, p_name""")
def surface_forms(t: Tables) -> DataFrame:
    """Names in use for a brand that are not among its known aliases (here: its first and last name)."""
    used = t.part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n_rows"))
    aliases = used.groupBy("p_brand").agg(F.array(F.min("p_name"), F.max("p_name")).alias("aliases"))
    return (
        used.join(aliases, "p_brand")
        .where(J.not_listed(F.col("p_name"), F.col("aliases")))
        .select("p_brand", F.col("p_name").alias("surface_form"), "n_rows")
    )


@query("""
SELECT n_name, array_to_string(coalesce(s, []), ',') AS segments FROM nation LEFT JOIN
  (SELECT c_nationkey, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS s FROM customer GROUP BY 1)
ON c_nationkey = n_nationkey""")
def nation_segments(t: Tables) -> DataFrame:
    """Ordered distinct list per nation, empty where there is none. The vocabulary of segments is closed."""
    pairs = t.customer.select("c_nationkey", "c_mktsegment").distinct()
    lists = pairs.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    nation = t.nation
    joined = nation.join(lists, nation.n_nationkey == lists.c_nationkey, "left")
    return joined.select("n_name", F.array_join(F.coalesce("s", F.array()), ",").alias("segments"))


@query("""
SELECT page_id, url, name, doc_id FROM pages LEFT JOIN (SELECT '/' || doc_id AS name, doc_id FROM documents)
ON url LIKE '%' || name""")
def page_document_links(t: Tables) -> DataFrame:
    names = t.documents.select(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("name"), "doc_id")
    return J.suffix_join(t.pages.select("page_id", "url"), "url", names, "name")


@query("""
SELECT c.conv_id, c.turn, p.turn AS parent_turn, p.role AS parent_role, length(c.text) - length(p.text) AS longer_by
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def replies(t: Tables) -> DataFrame:
    """Each turn with the turn it answers: a self join on the parent key, one row per turn and no pairs beyond it."""
    child = t.conversations.select("conv_id", "turn", F.length("text").alias("n"), (F.col("turn") - 1).alias("up"))
    parent = t.conversations.select(
        F.col("conv_id").alias("p_conv"), F.col("turn").alias("parent_turn"), F.col("role").alias("parent_role"),
        F.length("text").alias("p_n"),
    )
    same = (F.col("conv_id") == F.col("p_conv")) & (F.col("up") == F.col("parent_turn"))
    return child.join(parent, same, "left").select(
        "conv_id", "turn", "parent_turn", "parent_role", (F.col("n") - F.col("p_n")).cast("bigint").alias("longer_by")
    )


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn FROM conversations),
up AS (SELECT conv_id, turn, turn AS ancestor_turn, 0 AS depth FROM t
  UNION ALL SELECT up.conv_id, up.turn, p.turn, depth + 1 FROM up JOIN t p ON p.conv_id = up.conv_id AND p.turn = up.ancestor_turn - 1)
SELECT conv_id, turn, ancestor_turn, depth FROM up WHERE depth > 0""")
def turn_ancestors(t: Tables) -> DataFrame:
    """Each turn with all turns it goes back to."""
    turn = t.conversations.select(F.struct("conv_id", "turn").alias("node"), F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("parent"))
    edges = turn.join(turn.select(F.col("node").alias("parent")), "parent", "left_semi")
    return T.reach(edges, "node", "parent").select("node.conv_id", "node.turn", F.col("parent.turn").alias("ancestor_turn"), "depth")


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, role FROM conversations),
up AS (SELECT conv_id, turn, turn AS root_turn, 0 AS depth FROM t
  UNION ALL SELECT up.conv_id, up.turn, p.turn, depth + 1 FROM up JOIN t p ON p.conv_id = up.conv_id AND p.turn = up.root_turn - 1)
SELECT conv_id, turn, max_by(root_turn, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn""")
def conversation_roots(t: Tables) -> DataFrame:
    """Where the replies of each turn begin, and how deep it lies below."""
    turns = t.conversations.select("conv_id", "turn", (F.col("turn") - 1).alias("up"))
    found = T.roots(turns, ["conv_id", "turn"], ["conv_id", "up"])
    return found.select("conv_id", "turn", F.col("root.turn").alias("root_turn"), "depth")


@query("""
WITH RECURSIVE seen AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b,
    value FROM events WHERE value > 90),
e AS (SELECT DISTINCT user_id, a, b FROM seen WHERE b IS NOT NULL),
r AS (SELECT user_id, a, b, 1 AS depth FROM e UNION SELECT r.user_id, r.a, e.b, depth + 1 FROM r JOIN e ON e.user_id = r.user_id AND e.a = r.b WHERE depth < 6)
SELECT user_id, a AS from_type, b AS to_type, min(depth) AS depth FROM r GROUP BY ALL""")
def reachable_types(t: Tables) -> DataFrame:
    """Which kinds of large events of a user lead to which, in how few steps; the steps run in circles."""
    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    large = t.events.where("value > 90").withColumn("next", F.lead("event_type").over(line)).where("next IS NOT NULL")
    edges = large.select(F.struct("user_id", F.col("event_type").alias("kind")).alias("s"), F.struct("user_id", F.col("next").alias("kind")).alias("t"))
    found = T.reach(edges, "s", "t")
    return found.select("s.user_id", F.col("s.kind").alias("from_type"), F.col("t.kind").alias("to_type"), "depth")


@query("""
WITH RECURSIVE nodes AS (SELECT event_id, CASE WHEN event_type = 'error' THEN event_id - 7 WHEN event_id % 3 = 0 THEN event_id // 3 ELSE event_id // 10 END AS parent FROM events),
walk AS (SELECT event_id, event_id AS spot, 0 AS depth FROM nodes
  UNION ALL SELECT walk.event_id, p.event_id, depth + 1 FROM walk JOIN nodes n ON n.event_id = walk.spot JOIN nodes p ON p.event_id = n.parent WHERE depth < 60),
ends AS (SELECT event_id, max(depth) AS depth, max_by(spot, depth) AS root FROM walk GROUP BY event_id)
SELECT event_id, CASE WHEN depth < 60 THEN root END AS root, CASE WHEN depth < 60 THEN depth END AS depth FROM ends""")
def event_forest(t: Tables) -> DataFrame:
    """Roots of a forest over events with hot parents and event 0 as a circle of its own; what leads to 0 has no root."""
    at = F.col("event_id")
    parent = F.when(F.col("event_type") == "error", at - 7).when(at % 3 == 0, F.floor(at / 3)).otherwise(F.floor(at / 10))
    found = T.roots(t.events.select("event_id", parent.cast("bigint").alias("parent")), ["event_id"], ["parent"])
    return found.select("event_id", F.col("root.event_id").alias("root"), "depth")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS
  (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def orders_with_returns(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.join(returned, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def customers_without_finished(t: Tables) -> DataFrame:
    finished = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return t.customer.join(finished, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
AND len(list_intersect(['the', 'of'], regexp_extract_all(lower(text), '[a-z0-9]+'))) = 2""")
def match_in_scope(t: Tables) -> DataFrame:
    scope = t.labels.where("quality = 1").select("doc_id").distinct()
    return R.match_all_terms(t.documents.join(scope, "doc_id", "left_semi"), "text", "the of").select("doc_id", "lang")


@query("""
SELECT event_id, user_id FROM events WHERE event_type IN ('purchase', 'signup') AND list_contains([1, 2, 3, 5, 8, 13], user_id)""")
def events_of_named_users(t: Tables) -> DataFrame:
    kinds = F.array(F.lit("purchase"), F.lit("signup"))
    wanted = F.col("user_id").isin(1, 2, 3, 5, 8, 13) & A.has_grant(kinds, F.col("event_type"))
    return t.events.where(wanted).select("event_id", "user_id")


@query("""
SELECT o_orderkey, l.last_ship IS NULL AS open_ended FROM orders LEFT JOIN
  (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
WHERE l.last_ship IS NULL OR l.last_ship > TIMESTAMP '1999-01-01'""")
def still_open_orders(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_ship"))
    joined = t.orders.select("o_orderkey").join(last, "o_orderkey", "left")
    as_of = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    return joined.where(still_valid(F.col("last_ship"), as_of)).select(
        "o_orderkey", F.col("last_ship").isNull().alias("open_ended")
    )


@query("""
SELECT doc_id, lang, source FROM documents d
WHERE d.source IN ('src1', 'src2')
   OR (d.lang = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1))
   OR (d.lang = 'de' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1))""")
def visible_documents(t: Tables) -> DataFrame:
    """Three permissive policies for one reader: by source, by language unless toxic, by approved quality."""
    policies = [
        A.Policy(F.col("source").isin("src1", "src2")),
        A.Policy(F.col("lang") == "en", forbids=t.labels.where("toxic = 1"), key="doc_id"),
        A.Policy(F.col("lang") == "de", requires=t.labels.where("quality = 1"), key="doc_id"),
    ]
    return A.visible_rows(t.documents.select("doc_id", "lang", "source"), policies)


@query("""
SELECT 'part' AS target, l_partkey AS missing_key, count(*) AS n_rows FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) GROUP BY 2
UNION ALL
SELECT 'label', d.doc_id, count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 2
UNION ALL
SELECT 'document', vec_id, count(*) FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = vec_id) GROUP BY 2""")
def missing_references(t: Tables) -> DataFrame:
    checks = {
        "part": J.missing_references(t.lineitem, "l_partkey", t.part, "p_partkey"),
        "label": J.missing_references(t.documents, "doc_id", t.labels, "doc_id"),
        "document": J.missing_references(t.embeddings, "vec_id", t.documents, "doc_id"),
    }
    return S.union_all([df.select(F.lit(n).alias("target"), "missing_key", "n_rows") for n, df in checks.items()])
