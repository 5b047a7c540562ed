"""DuckDB SQL for the queries of this subpackage that SQL can express."""

URL_RULES = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rhost, rpath, rule, verdict) AS (VALUES
  ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fit USING (page_id)
"""

DECONTAMINATE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
spans AS (SELECT item_id, w, least(13, len(w)) AS span FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, span, array_to_string(w[p:p + span - 1], ' ') AS phrase
  FROM (SELECT item_id, w, span, unnest(range(1, len(w) - span + 2)) AS p FROM spans)),
places AS (
  SELECT doc_id, p, span, array_to_string(w[p:p + span - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS p FROM docs, (SELECT DISTINCT span FROM windows))),
hits AS (SELECT doc_id, p, span, item_id FROM places JOIN windows USING (span, phrase)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + span)) AS q FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * shared >= 85 * (m.n + n.n - shared)),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM docs)),
firsts AS (SELECT s, min(struct_pack(d := doc_id, p := p)) AS f FROM windows GROUP BY 1 HAVING count(*) > 1),
gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM windows JOIN firsts USING (s) WHERE f <> struct_pack(d := doc_id, p := p)),
flat AS (SELECT doc_id, q, w[q] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM docs)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS said FROM flat ANTI JOIN gone USING (doc_id, q) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM worded),
grams AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM runs)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING c >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY 1),
cand AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, c FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, w, c, k, unnest(range(1, k)) AS place FROM cand),
scored AS (
  SELECT t.lang, t.phrase, t.c AS a, place, x.c AS l, y.c AS r, n, (1000::HUGEINT * t.c * n) // (x.c::HUGEINT * y.c) AS score
  FROM cuts t JOIN totals USING (lang)
  JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(w[1:place], ' ') JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(w[place + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) AS nth FROM scored),
inner_runs AS (SELECT lang, w, k, c, unnest(range(2, k)) AS m FROM cand WHERE k > 2),
inside AS (SELECT lang, array_to_string(w[p:p + m - 1], ' ') AS phrase, max(c) AS longer FROM (SELECT lang, w, m, c, unnest(range(1, k - m + 2)) AS p FROM inner_runs) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE nth = 1 AND NOT coalesce(100 * longer >= 100 * a, false)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranks WHERE rank <= 2000
"""



BYTE_DEDUP = r"""
WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS p FROM docs)),
firsts AS MATERIALIZED (SELECT s, min(doc_id) AS f FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
starts AS MATERIALIZED (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE doc_id > f),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM starts),
flat AS (SELECT doc_id, q, substr(h, 2 * q - 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS q FROM docs)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY q) AS h FROM flat ANTI JOIN gone USING (doc_id, q) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
spans AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, q - 1 AS q FROM gone) ANTI JOIN gone USING (doc_id, q) GROUP BY 1)
SELECT doc_id, (length(docs.h) // 2)::BIGINT AS n_bytes, coalesce(lost.n, 0)::BIGINT AS n_removed, coalesce(spans.n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM docs LEFT JOIN lost USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _centroids(rounds: int = 10, clusters: int = 8) -> str:
    """Integer k-means, a few common tables for each round."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "flat AS MATERIALIZED (SELECT rid, d, v[d] AS x FROM (SELECT rid, v, unnest(range(1, 65)) AS d FROM kept))",
        f"""c0 AS MATERIALIZED (
  SELECT j, d, v[d] AS c FROM (SELECT j, v, unnest(range(1, 65)) AS d FROM (
    SELECT v, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS j FROM kept) WHERE j < {clusters}))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""near{r} AS MATERIALIZED (
  SELECT rid, min(struct_pack(distance := distance, j := j)) AS best
  FROM (SELECT rid, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM flat JOIN c{r} USING (d) GROUP BY 1, 2) GROUP BY 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT j, d, coalesce((s - ((s % n) + n) % n) // n, c) AS c
  FROM c{r} LEFT JOIN (SELECT best.j AS j, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM near{r} JOIN flat USING (rid) GROUP BY 1, 2) USING (j, d))""")
    parts.append(f"named AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY 1)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, best.distance AS distance, CAST(sum(best.distance) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM kept JOIN near{rounds} USING (rid) JOIN named ON named.j = best.j"""


ORACLES: dict[str, str] = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op7_url_rules": URL_RULES,
    "op11_collocations": COLLOCATIONS,
    "op12_centroids": _centroids(),
    "op13_suffix_dedup": BYTE_DEDUP,
}
