"""The registered queries of this package: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlode.llm import chosen_path, decontaminate, exact_dedup, hard_negatives, html_text, knn_join, licenses, merkle_manifest, mixing, oracles, quality, secrets, token_counts, warc
from paperlode.plans.registry import Query, Tables

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = Query(build, sql)
        return build

    return add


@query("""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM f
""")
def op2_warc_revisits(t: Tables):
    """Archives of all pages, with repeated payloads as revisits, read back."""
    return warc.archive_and_resolve(t.pages, min_bytes=100)


@query(f"""
WITH d AS (SELECT doc_id, sha256({oracles.LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op3_exact_dedup(t: Tables):
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.exact_dedup(t.documents, keep="largest").drop("text_hash")


@query()
def op10_token_counts(t: Tables):
    """Tokens under the byte-level vocabulary of 50,257 entries; no SQL can merge byte pairs."""
    import public_tokenizers

    definition = token_counts.read_definition(t.spark, "file://" + public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.token_counts(t.documents, definition)


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all({oracles.LOWERED}, {oracles.WORDS}) AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all({oracles.LOWERED}, {oracles.WORDS}) AS w FROM benchmark),
     s AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
           FROM b WHERE len(w) > 0),
     bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM s),
     lengths AS (SELECT DISTINCT n FROM bw),
     e AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
     h AS (SELECT doc_id, i, n, item_id
           FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM e) JOIN bw USING (n, g)),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h)
             GROUP BY doc_id),
     iw AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w))) AS o, unnest(w) AS term FROM b WHERE len(w) > 0),
     dw AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS term FROM d),
     moved AS (SELECT DISTINCT doc_id, item_id, n, o, unnest(range(pos - o - 2, pos - o + 3)) AS shift FROM dw JOIN iw USING (term)),
     close AS (SELECT doc_id, item_id FROM moved GROUP BY doc_id, item_id, n, shift HAVING count(*) >= ceil(0.8 * n - 1e-9)),
     near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close GROUP BY doc_id),
     found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
""")
def op5_decontaminate(t: Tables):
    """Benchmark words in documents by windows of 13, and benchmark items with words moved, replaced or missing."""
    return decontaminate.contamination(t.documents, t.benchmark, window=13, one_in=20, slop=2)


@query(oracles.SECRETS)
def op7_secret_scan(t: Tables):
    """Credential patterns and strings of high entropy."""
    return secrets.scan_secrets(t.documents)


@query()
def op1_quality_classifier(t: Tables):
    """Score of every document; tested by held-out accuracy."""
    return quality.score(t.documents, quality.fit(t.documents, t.labels), threshold=0.3)


@query()
def op6_html_text(t: Tables):
    """Main text of every page; tested against pages whose text is known."""
    return html_text.extract_text(t.pages)


@query(oracles.LINKS)
def op8_chosen_path_join(t: Tables):
    """Near copies: class and number of links of every document."""
    found = chosen_path.similar_documents(t.documents)
    return found.select("doc_id", "class_id", "n_links")


@query()
def op9_source_mixing(t: Tables):
    """Copies of every document when the weights have 95 % of the highest entropy and spend as many tokens as there are."""
    return mixing.mix_report(t.documents, mixing.plan(t.documents, entropy_share=0.95, spent_passes=1.0))


@query(oracles.LICENSES)
def op4_license_scan(t: Tables):
    """Licence of every document. Its path is source, language and id; two in three lie one or two directories deeper."""
    key = F.col("doc_id")
    deeper = F.when(key % 3 == 1, F.concat(F.lit("d"), key % 5)).when(key % 3 == 2, F.concat(F.lit("d"), key % 5, F.lit("/e"), key % 2))
    path = F.concat_ws("/", "source", "lang", deeper, key.cast("string"))
    return licenses.license_scan(t.documents, path)


@query(oracles.MANIFEST)
def op13_merkle_manifest(t: Tables):
    """Leaf, proof and verification of every document, with one document in five tampered with."""
    return merkle_manifest.manifest(t.documents).drop("version")


@query(oracles.NEIGHBOURS)
def op11_voronoi_knn(t: Tables):
    """The five best other vectors of every fiftieth vector."""
    return knn_join.top_k(t.embeddings, F.col("vec_id") % 50 == 0, k=5)


@query(oracles.NEGATIVES)
def op12_gnat_negatives(t: Tables):
    """Hard negatives of every hundredth vector, where every seventh label is wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(t.embeddings, F.col("vec_id") % 100 == 0, label)
