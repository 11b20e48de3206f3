"""DuckDB twins of the operators' queries that SQL can express."""

from __future__ import annotations

from .mixing import DRAW_DIGITS
from .licenses import LICENSE_FILE, TEXTS, THRESHOLD, Templates

OP6 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
 f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d"""

OP3 = f"""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
  CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, {DRAW_DIGITS}) AS BIGINT) / {float(16**DRAW_DIGITS)!r} AS draw FROM documents),
 p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
 w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM p),
 f AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(most) OVER below, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS weight_from FROM w
   WINDOW below AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, least(most, max((total - full_before) / weight_from) OVER () * weight) AS target FROM f),
 r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM t),
 c AS (SELECT doc_id, size, d.source, source_size, target, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, copies * size AS taken, source, copies FROM c"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
 k AS (SELECT doc_id, md5(string_agg(g, chr(0) ORDER BY g)) AS h FROM s GROUP BY 1),
 q AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM k)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(q.class_id, d.doc_id) AS class_id FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id"""

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
TERMS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""WITH d AS (SELECT row_number() OVER () AS no, doc_id, {TERMS} AS ts FROM documents),
 x AS (SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM d),
 m AS (SELECT no, doc_id, 75 + (25 * len(ts) * big_n) // big_l AS m FROM d, x WHERE len(ts) > 0),
 tf AS (SELECT no, t, count(*) AS tf FROM (SELECT no, unnest(ts) AS t FROM d) GROUP BY 1, 2),
 w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY 1), x),
 q AS (SELECT item, item_id, unnest({TERMS}) AS t FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
 s AS (SELECT item, item_id, no, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (no) GROUP BY 1, 2, 3),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN m USING (no) WHERE score > 0)
SELECT * FROM r WHERE rank <= 20"""

OP12 = f"""WITH RECURSIVE p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
 g AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
   FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k) GROUP BY ALL),
 n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE k = 1 GROUP BY 1),
 c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 100),
 cuts AS (SELECT c.lang, c.phrase, c.k, c.a, j, l.f AS l, r.f AS r, CAST((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score, n.n AS n
   FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n ON n.lang = c.lang
   JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:c.k], ' ')),
 one AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 inner_ AS (SELECT lang, a, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:k], ' ')]) AS phrase FROM c WHERE k > 2),
 gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase WHERE 100 * i.a >= 100 * c.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM one
 WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = one.lang AND gone.phrase = one.phrase) QUALIFY rank <= 2000"""


def op1() -> str:
    t = Templates(TEXTS)
    quoted = lambda w: "'" + w + "'"
    weights = ", ".join(f"({quoted(w)}, {i}, {x!r})" for w, xs in t.weights.items() for i, x in enumerate(xs) if x)
    idf = ", ".join(f"({quoted(w)}, {x!r})" for w, x in t.idf.items())
    names = ", ".join(f"({i}, {quoted(n)}, {len(ws)})" for i, (n, ws) in enumerate(zip(t.names, t.words)))
    anchors = ", ".join(f"({i}, {quoted(w)}, {ws.index(w)})" for i, (ws, own) in enumerate(zip(t.words, t.own_anchors)) for w in own)
    wholes = ", ".join(f"({i}, {j})" for i, js in enumerate(t.wholes) for j in js)
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""WITH f AS (SELECT row_number() OVER () AS id, doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(CAST(doc_id // 1000 AS VARCHAR), 'none'), coalesce(CAST(doc_id // 100 AS VARCHAR), 'none'), coalesce(CAST(doc_id AS VARCHAR), 'none')) AS path, {words} AS ws FROM documents),
 idf AS (SELECT * FROM (VALUES {idf}) AS t(w, idf)), weight AS (SELECT * FROM (VALUES {weights}) AS t(w, i, x)), nm AS (SELECT * FROM (VALUES {names}) AS t(i, license, size)),
 anchor AS (SELECT * FROM (VALUES {anchors}) AS t(i, w, place)), whole AS (SELECT * FROM (VALUES {wholes}) AS t(i, j)),
 pos AS (SELECT id, p, ws[p + 1] AS w FROM (SELECT id, ws, unnest(range(0, len(ws))) AS p FROM f)),
 laid AS (SELECT DISTINCT id, i, p - place AS a0 FROM pos JOIN anchor USING (w)),
 win AS (SELECT id, i, greatest(a0, 0) AS s, list_slice(ws, greatest(a0, 0) + 1, a0 + size) AS ws FROM laid JOIN nm USING (i) JOIN f USING (id)),
 tf AS (SELECT id, i, s, e, w, 1 + ln(count(*)) AS tf FROM (SELECT id, i, s, s + len(ws) AS e, unnest(ws) AS w FROM win) GROUP BY ALL),
 sc AS (SELECT id, i, s, e, round(coalesce(sum(tf * idf * x), 0) / sqrt(sum((tf * coalesce(idf, {t.unseen!r})) ** 2)), 9) AS score FROM tf LEFT JOIN idf USING (w) LEFT JOIN weight USING (w, i) GROUP BY ALL),
 hit AS (SELECT id, i, s, e, score FROM sc WHERE score >= {THRESHOLD}),
 run AS (SELECT id, s, e, coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM hit),
 per AS (SELECT id, CAST(sum(CASE WHEN s >= reach THEN 1 ELSE 0 END) AS INTEGER) AS n, sum(greatest(0, e - greatest(s, reach))) AS covered FROM run GROUP BY 1),
 top AS (SELECT h.id, license, score FROM hit h JOIN nm USING (i) WHERE NOT EXISTS (SELECT 1 FROM whole JOIN hit y ON y.i = whole.j WHERE whole.i = h.i AND y.id = h.id AND y.s < h.e AND h.s < y.e)
   QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY score DESC, license) = 1),
 rows_ AS (SELECT f.id, f.doc_id, f.path, regexp_replace(f.path, '/[^/]*$', '') AS dir, coalesce(n, 0) AS n_notices, coalesce(n > 0 AND (regexp_matches(string_split(f.path, '/')[-1], '{LICENSE_FILE}') OR covered * 2 >= len(ws)), false) AS is_license_file, license AS own_license, score AS own_score
   FROM f LEFT JOIN per ON per.id = f.id LEFT JOIN top ON top.id = f.id),
 dirs AS (SELECT dir AS licensed_dir, own_license AS dir_license FROM rows_ WHERE is_license_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1),
 up AS (SELECT DISTINCT dir, s, array_to_string(list_slice(string_split(dir, '/'), 1, len(string_split(dir, '/')) - s), '/') AS licensed_dir FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS s FROM rows_)),
 near AS (SELECT dir, licensed_dir, dir_license FROM up JOIN dirs USING (licensed_dir) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY s) = 1)
SELECT doc_id, path, r.dir, n_notices, is_license_file, own_license, round(own_score, 6) AS own_score, coalesce(own_license, dir_license) AS license,
 CASE WHEN own_license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own_license IS NULL THEN licensed_dir END AS licensed_dir FROM rows_ r LEFT JOIN near ON near.dir = r.dir"""
