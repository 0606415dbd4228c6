"""SQL that returns the rows of the longer queries by plain means: all pairs, all windows, all vectors."""

from __future__ import annotations

from paperlode.llm import licenses, secrets
from paperlode.llm.common import NEAR_COPY, SHINGLE_WORDS

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: int, pattern: str, condition: str, group: int = 0) -> str:
    """(doc_id, kind, start, end, value) of the matches of a pattern, by the lengths of the gaps between them."""
    p = quoted(pattern)
    return f"""
SELECT doc_id, {kind} AS kind, before::BIGINT AS start, (before + length(m[i]))::BIGINT AS stop, m[i] AS value
FROM (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS before
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS g, regexp_extract_all(text, {p}) AS m,
                         regexp_extract_all(text, {p}, {group}) AS v FROM texts)))
WHERE {condition}"""


def _cut(text: str) -> str:
    for pattern, n in secrets.ALLOWED:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(secrets.CUT * n)}, 'g')"
    return text


def _looks() -> str:
    """Whether a window has what its class needs, and enough entropy."""
    return " OR ".join(
        f"class = {k} AND h >= {c.least_bits} AND " + " AND ".join(f"regexp_matches(w, {quoted(p)})" for p in c.needs)
        for k, c in enumerate(secrets.CLASSES)
    )


SECRETS = f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (WITH texts AS (SELECT * FROM whole) {_matches(0, secrets.ASSIGN, f"length(v[i]) >= {secrets.ASSIGN_CHARS}", 2)} UNION ALL
  {_matches(1, secrets.ACCESS, f"length(m[i]) >= {secrets.ACCESS_CHARS}")} UNION ALL {_matches(2, secrets.HEX, "true")}),
runs AS (WITH texts AS (SELECT doc_id, {_cut("text")} AS text FROM whole)
  {" UNION ALL ".join(_matches(k, c.runs, "true") for k, c in enumerate(secrets.CLASSES))}),
windows AS (SELECT doc_id, kind AS class, start, stop, unnest(range(1, length(value) - {secrets.WINDOW - 2})) AS i, value FROM runs),
cut AS (SELECT doc_id, class, start, stop, i, substring(value, i, {secrets.WINDOW}) AS w FROM windows),
letters AS (SELECT doc_id, class, start, stop, i, w, unnest(string_split(w, '')) AS c FROM cut),
counts AS (SELECT doc_id, class, start, stop, i, w, c, count(*) AS n FROM letters GROUP BY ALL),
bits AS (SELECT doc_id, class, start, stop, i, w, log2({secrets.WINDOW}) - sum(n * log2(n)) / {secrets.WINDOW} AS h FROM counts GROUP BY ALL),
random AS (SELECT DISTINCT doc_id, start, stop FROM bits WHERE {_looks()}),
high AS (SELECT doc_id, 3 AS kind, start, stop FROM random r
         WHERE NOT EXISTS (SELECT 1 FROM random o WHERE o.doc_id = r.doc_id AND o.start <= r.start AND o.stop >= r.stop AND o <> r)),
spans AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT * FROM high),
named AS (SELECT doc_id, kind, start, [{", ".join(f"'{k}'" for k in secrets.KINDS)}][kind + 1] || ':' || start || ':' || stop AS s FROM spans),
listed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{name}" for k, name in enumerate(secrets.KINDS))},
  string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM whole t LEFT JOIN listed USING (doc_id)"""


LINKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= {NEAR_COPY} * (x.n + y.n - k) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
firsts AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(least(d.doc_id, firsts.b), d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN firsts ON firsts.a = d.doc_id LEFT JOIN degree ON degree.a = d.doc_id"""


def _tree(name: str, leaves: str) -> str:
    """Levels of 16-ary trees over (grp, pos, digest): (grp, lvl, pos, digest, n), n nodes in the level."""
    return f"""
{name} AS (SELECT grp, 0 AS lvl, pos, digest, count(*) OVER (PARTITION BY grp) AS n FROM {leaves}
  UNION ALL SELECT grp, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16)
  FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 16)"""


def _levels(name: str, tree: str) -> str:
    """(grp, pos, s): what stands before and after the ancestors of each leaf, level by level."""
    return f"""
{name}_runs AS (SELECT grp, lvl, pos // 16 AS run, string_agg(digest, '' ORDER BY pos) AS joined FROM {tree} WHERE n > 1 GROUP BY ALL),
{name}_at AS (SELECT l.grp, l.pos, r.lvl, joined, (l.pos // pow(16, r.lvl)::BIGINT) % 16 AS place
  FROM (SELECT grp, pos FROM {tree} WHERE lvl = 0) l JOIN {name}_runs r ON r.grp = l.grp AND r.run = l.pos // pow(16, r.lvl + 1)::BIGINT),
{name} AS (SELECT grp, pos, list({{'b': substr(joined, 1, 64 * place), 'a': substr(joined, 64 * place + 65)}} ORDER BY lvl) AS s FROM {name}_at GROUP BY ALL)"""


#: CRC-32 of the decimal text of doc_id, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


MANIFEST = f"""
WITH RECURSIVE rows AS (SELECT doc_id, coalesce('=' || source, '-') AS grp, {_leaf("text")} AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("lowered")} END AS tampered
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows),
low_leaves AS (SELECT grp, pos, leaf AS digest FROM placed), {_tree("low", "low_leaves")},
subroots AS (SELECT grp AS source, digest, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM low WHERE n = 1),
top_leaves AS (SELECT '' AS grp, pos, digest FROM subroots), {_tree("high", "top_leaves")},
root AS (SELECT digest AS root FROM high WHERE n = 1), {_levels("inner_path", "low")}, {_levels("outer_path", "high")},
paths AS (SELECT p.doc_id, p.leaf, p.tampered, r.digest AS subroot, list_concat(coalesce(i.s, []), coalesce(o.s, [])) AS s
  FROM placed p JOIN subroots r ON r.source = p.grp LEFT JOIN inner_path i ON i.grp = p.grp AND i.pos = p.pos
  LEFT JOIN outer_path o ON o.pos = r.pos),
folded AS (SELECT *, list_reduce(list_concat([{{'b': coalesce(tampered, leaf), 'a': ''}}], s),
  lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(s, lambda x: x.b || x.a), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded, root"""


_VECTORS = """v AS (SELECT *, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

NEIGHBOURS = f"""
WITH {_VECTORS}, pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

NEGATIVES = f"""
WITH {_VECTORS}, l AS (SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM v WHERE label IS NOT NULL),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM l a JOIN l c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5"""


_TEMPLATES = ", ".join(f"({i}, {quoted(t.license)}, {quoted(t.text)})" for i, t in enumerate(licenses.TEMPLATES))
_OPENINGS = ", ".join(f"({i}, {t.words})" for i, t in enumerate(licenses.TEMPLATES) if t.words)
_DEEPER = """CASE doc_id % 3 WHEN 1 THEN 'd' || doc_id % 5 WHEN 2 THEN 'd' || doc_id % 5 || '/e' || doc_id % 2 END"""


def _cosine(name: str, source: str, key: str) -> str:
    """Cosines of word lists (key, w) to all templates."""
    return f"""
{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM {source}) GROUP BY ALL),
{name}_v AS (SELECT {key}, term, idf IS NOT NULL AS known, (1 + ln(tf)) * coalesce(idf, rarest) AS x FROM {name}_tf LEFT JOIN idf USING (term), total),
{name}_n AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name}_v GROUP BY ALL),
{name} AS (SELECT {key}, template, license, -round(sum(x * unit) / any_value(norm), 9) AS o, -round(sum(unit * unit), 9) AS part
           FROM {name}_v JOIN units USING (term) JOIN {name}_n USING ({key}) GROUP BY {key}, template, license)"""


LICENSES = f"""
WITH d AS (SELECT doc_id, concat_ws('/', source, lang, {_DEEPER}, doc_id::VARCHAR) AS path, concat_ws('/', source, lang, {_DEEPER}) AS dir, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM d),
templates AS (SELECT template, license, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM (VALUES {_TEMPLATES}) t(template, license, text)),
terms AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(w) AS term FROM templates) GROUP BY ALL),
total AS (SELECT count(*) AS n, 1 + ln(count(*) + 1) AS rarest FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM words) GROUP BY term),
idf AS (SELECT term, 1 + ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM (SELECT DISTINCT term FROM terms) LEFT JOIN df USING (term), total),
weights AS (SELECT template, license, term, (1 + ln(tf)) * idf AS x FROM terms JOIN idf USING (term)),
units AS (SELECT template, license, term, x / sqrt(sum(x * x) OVER (PARTITION BY template)) AS unit FROM weights),
cuts AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS own,
  flatten(list_transform(regexp_split_to_array(regexp_replace(text, {quoted(licenses.MARKS)}, '\\1', 'g'), {quoted(licenses.BLANK)}),
    lambda p: string_split(regexp_replace(replace(p, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)))) AS joined FROM d),
passages AS (SELECT doc_id, row_number() OVER () AS passage, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM
  (SELECT doc_id, unnest(list_distinct(list_concat(own, joined))) AS text FROM cuts)),
{_cosine("p", "passages", "passage")}, {_cosine("f", "words", "doc_id")},
h AS (SELECT doc_id, min({{'o': o, 'license': license}}) AS h FROM p JOIN (SELECT passage, doc_id FROM passages) USING (passage) WHERE -o >= {licenses.HEADER} GROUP BY doc_id),
w AS (SELECT doc_id, min({{'o': CASE WHEN n IS NULL THEN o ELSE part END, 'license': license}}) AS f
  FROM f JOIN words USING (doc_id) LEFT JOIN (VALUES {_OPENINGS}) long(template, n) USING (template)
  WHERE CASE WHEN n IS NULL THEN -o >= {licenses.FILE} ELSE -part >= {licenses.OPENING} AND len(w) BETWEEN {1 - licenses.ABOUT} * n AND {1 + licenses.ABOUT} * n END
  GROUP BY doc_id),
own AS (SELECT d.*, h, f FROM d LEFT JOIN h USING (doc_id) LEFT JOIN w USING (doc_id)),
given AS (SELECT dir, min({{'o': f.o, 'path': path, 'license': f.license}}) AS g FROM own WHERE f IS NOT NULL GROUP BY dir),
nearest AS (SELECT p.dir, max_by(given.g, length(given.dir)) AS g FROM (SELECT DISTINCT dir FROM own) p
  JOIN given ON p.dir = given.dir OR starts_with(p.dir, given.dir || '/') OR given.dir = '' GROUP BY p.dir)
SELECT doc_id, path, coalesce(coalesce(h, f).license, g.license) AS license,
  CASE WHEN f IS NOT NULL THEN 'file' WHEN h IS NOT NULL THEN 'header' WHEN g IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  round(-coalesce(coalesce(h, f).o, g.o), 6) AS cosine, CASE WHEN h IS NULL AND f IS NULL THEN g.path END AS from_path
FROM own LEFT JOIN nearest g USING (dir)"""
