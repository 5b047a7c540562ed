"""DuckDB SQL of the queries in reports."""

from __future__ import annotations

from .oracles import ALIGNED, LINES, LOOKUP, ORACLES as BASE, PREDICTIONS, norm, page_runs, similarity, words

WINDOWS = "CASE WHEN n <= 496 THEN 1 ELSE 1 + ceil((n - 496) / 368.0)::BIGINT END"
SIZES = f"p AS (SELECT doc_id AS page_id, lang, source, len({words('text')}) AS n FROM documents)"
SPACES = r"trim(regexp_replace(question, '\s+', ' ', 'g'))"


def counts(column: str, where: str = "true") -> str:
    """Values with their numbers, as one string in the order of the values."""
    return f"(SELECT string_agg(v || '=' || k, '; ' ORDER BY v) FROM (SELECT {column} AS v, count(*) AS k FROM scored x WHERE x.system_id = s.system_id AND x.field = s.field AND {where} GROUP BY 1))"


ORACLES: dict[str, str] = {
    "page_fits": f"WITH {SIZES} SELECT page_id, {WINDOWS} AS n_windows, {WINDOWS} = 1 AS fits FROM p",
    "window_summary": f"WITH {SIZES}, k AS (SELECT lang, {WINDOWS} AS k FROM p) SELECT lang, count(*) AS n, count(*) FILTER (k = 1) AS single, count(*) FILTER (k > 1) AS windowed, round(avg(k), 9) AS mean, max(k) AS most FROM k GROUP BY lang",
    "span_tokens": f"""WITH w AS (SELECT doc_id AS page_id, {words("text")} AS w FROM documents), t AS (SELECT page_id, i - 1 AS i, ceil(length(w[i]) / 6.0)::BIGINT AS k FROM (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
c AS (SELECT page_id, i, 2 + sum(k) OVER (PARTITION BY page_id ORDER BY i) AS upto, k FROM t)
SELECT w.page_id, min(upto - k)::INT AS first_token, (max(upto) - 1)::INT AS last_token FROM w LEFT JOIN c ON c.page_id = w.page_id AND i BETWEEN w.page_id % 7 AND w.page_id % 7 + w.page_id % 3 GROUP BY 1""",
    "first_pages_by_id": f"WITH {SIZES} SELECT page_id, source, n::INT AS n_words FROM p ORDER BY page_id LIMIT 20",
    "input_manifest": f"""WITH {LOOKUP.partition("content AS")[0].rstrip().rstrip(",")}, q AS (SELECT page_id, {SPACES} AS question, len(words)::INT AS n_words FROM asked),
f AS (SELECT *, CASE WHEN n_words = 0 THEN 'no_words' WHEN n_words > 2000 THEN 'too_many_words' WHEN question = '' THEN 'blank_question' WHEN length(question) > 256 THEN 'long_question' END AS finding FROM q)
SELECT page_id, question, n_words, CASE WHEN finding IS NULL THEN 'accepted' ELSE 'refused' END AS verdict, finding FROM f""",
    "dataset_manifest": """SELECT lang, count(*) AS records, count(DISTINCT text) AS pages, bit_xor(('0x' || left(sha256(concat_ws('|', doc_id::VARCHAR, text)), 15))::BIGINT) AS digest, count(*) BETWEEN 8 AND 20000 AS accepted FROM documents GROUP BY lang""",
    "system_reports": f"""WITH {PREDICTIONS}, gold AS (SELECT receipt, field, raw_text AS gold FROM predictions WHERE system_id = 'exact'),
reasons AS (SELECT system_id, field, count(*) FILTER (contains(raw_text, '.')) AS k FROM scored GROUP BY 1, 2),
t AS (SELECT system_id, field, state, {norm("raw_text")} AS a, {norm("gold")} AS b FROM scored JOIN gold USING (receipt, field)), u AS (SELECT *, {similarity("a", "b")} AS sim FROM t),
s AS (SELECT system_id, field, count(*) FILTER (state = 'present_usable') AS usable, avg((a = b)::INT) FILTER (state = 'present_usable') AS text_em, avg(CASE WHEN sim >= 0.5 THEN sim ELSE 0 END) FILTER (state = 'present_usable') AS anls FROM u GROUP BY 1, 2)
SELECT system_id, field, usable, round(text_em, 9) AS text_em, round(anls, 9) AS anls, {counts("parse_status")} AS prediction_states, {counts("parse_status", "state = 'present_usable'")} AS states_on_usable, {counts("state")} AS reference_states,
  CASE WHEN usable = 0 THEN 'not-measurable' WHEN usable >= 50 THEN 'measured' ELSE 'measured-small-sample' END AS verdict, (SELECT CASE WHEN k > 0 THEN 'separator_grammar=' || k ELSE '' END FROM reasons r WHERE r.system_id = s.system_id AND r.field = s.field) AS failure_reasons FROM s""",
    "training_examples": f"""WITH {ALIGNED}, o AS (SELECT a.*, state FROM aligned a JOIN refs USING (receipt, field)),
k AS (SELECT *, CASE WHEN state <> 'present_usable' THEN state ELSE status END AS why, count(*) FILTER (state = 'present_usable' AND status = 'aligned') OVER (PARTITION BY receipt ORDER BY field ROWS UNBOUNDED PRECEDING) AS n FROM o),
z AS (SELECT *, CASE WHEN why = 'aligned' AND n > 2 THEN 'per_receipt_ceiling' ELSE why END AS outcome FROM k)
SELECT receipt, field, outcome, CASE WHEN outcome = 'aligned' THEN line END AS line, CASE WHEN outcome = 'aligned' THEN start END AS start, CASE WHEN outcome = 'aligned' THEN "end" END AS "end" FROM z""",
    "off_page_answers": f"""WITH {LINES}, {PREDICTIONS.partition("refs AS")[1]}{PREDICTIONS.partition("refs AS")[2]}, pages AS (SELECT receipt, list(text ORDER BY line, pos) AS page FROM tokens GROUP BY 1), {page_runs("receipt", "page", "pages")}
SELECT receipt, system_id, field, raw_text FROM predictions p SEMI JOIN pages USING (receipt) ANTI JOIN runs ON (runs.receipt, run) = (p.receipt, {norm("raw_text")}) WHERE coalesce(raw_text, '') <> '' ORDER BY receipt, system_id, field LIMIT 15""",
    "field_examples": f"""WITH {PREDICTIONS}, c AS (SELECT system_id || '/' || field AS category, receipt, row_number() OVER (PARTITION BY system_id, field ORDER BY sha256('examples|' || receipt)) AS place FROM scored WHERE correct IS NOT NULL)
SELECT category, place::INT AS place, receipt FROM c WHERE place <= 2""",
    "confident_wrong": f"WITH {PREDICTIONS} SELECT system_id, receipt, span_score FROM totals WHERE correct = false AND span_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY span_score DESC, receipt) = 1",
    "reading_order": f"""WITH {LINES}, l AS (SELECT receipt, line, row_number() OVER (PARTITION BY receipt ORDER BY min(y0), min(x0), line) - 1 AS row FROM tokens GROUP BY receipt, line)
SELECT receipt, line, pos::INT AS pos, row::INT AS row, (row_number() OVER (PARTITION BY receipt, line ORDER BY x0, y0, pos) - 1)::INT AS place FROM tokens JOIN l USING (receipt, line)""",
    "reference_words": f"""WITH {LINES}, n AS (SELECT receipt, line, pos, row_number() OVER (PARTITION BY receipt ORDER BY line, pos) - 1 AS id, text FROM tokens)
SELECT receipt, count(*)::INT AS n_words, sha256(string_agg(id || ':' || text || ':' || line, chr(10) ORDER BY id)) AS digest FROM n GROUP BY 1""",
    "shown_amounts": f"WITH {PREDICTIONS} SELECT system_id, receipt, field, coalesce(normalized_amount, '') AS amount, coalesce(printf('%.2f', span_score), 'undefined') AS score FROM predictions",
    "cache_keys": """SELECT page_id, sha256('{"content":"' || sha256(html) || '","engine":"table","psm":6}') AS key FROM pages""",
    "row_lookup": """WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row, doc_id FROM documents), a AS (SELECT source, unnest(range(0, 61, 3)) AS row FROM (SELECT DISTINCT source FROM documents))
SELECT source, row, doc_id FROM a LEFT JOIN r USING (source, row)""",
    "split_shortfalls": f"""WITH s AS ({BASE["greedy_split"]}), n AS (SELECT greatest(1, count(*) // 3) AS least FROM s), k AS (SELECT unnest(['train', 'validation', 'test']) AS split)
SELECT k.split, count(s.split) AS n, least::BIGINT AS least, least - count(s.split) AS missing FROM k CROSS JOIN n LEFT JOIN s ON s.split = k.split GROUP BY k.split, least HAVING count(s.split) < least""",
}

PARAPHRASE = "CASE question WHEN 'What is the total amount?' THEN 'How much is the total?' WHEN 'What is the subtotal?' THEN 'How much is the subtotal?' ELSE question END"
ORACLES["paraphrases"] = f"""WITH q AS ({BASE["page_questions"]}), n AS (SELECT question, {PARAPHRASE} AS paraphrase, count(*) AS n FROM q GROUP BY 1, 2),
s AS (SELECT *, {norm("paraphrase")} AS a, {norm("question")} AS b FROM n), t AS (SELECT *, {similarity("a", "b")} AS sim FROM s)
SELECT question, paraphrase, n, round(CASE WHEN sim >= 0.5 THEN sim ELSE 0 END, 9) AS anls FROM t"""

ORACLES["window_decode"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE * 8) AS x FROM embeddings),
w AS (SELECT vec_id, x, unnest(range(0, greatest(0, ceil((len(x) - 24) / 16.0)::BIGINT) + 1)) AS w FROM v),
f AS (SELECT vec_id, w, i, exp(x[i]) AS ei, exp(x[i] * (i % 5 - 2)) AS ri FROM (SELECT *, unnest(range(w * 16 + 1, least(w * 16 + 24, len(x)) + 1)) AS i FROM w) WHERE vec_id % 10 <> 0),
t AS (SELECT vec_id, w, sum(ei) AS s, sum(ri) AS r FROM f GROUP BY 1, 2),
p AS (SELECT a.vec_id, a.w, a.i, b.i AS j, a.ei / s * (b.ri / r) AS raw FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.w = b.w AND b.i BETWEEN a.i AND a.i + 14 JOIN t ON (t.vec_id, t.w) = (a.vec_id, a.w)),
b AS (SELECT vec_id, (i - 1) // 2 AS start, (j - 1) // 2 AS stop, raw FROM p WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(raw, 15) DESC, w, i, j) = 1),
n AS (SELECT vec_id, count(*) AS n_windows FROM w GROUP BY 1)
SELECT vec_id, start::INT AS start, stop::INT AS "end", round(raw, 9) AS score, n_windows FROM n LEFT JOIN b USING (vec_id)"""


def uniform(*parts: str) -> str:
    return f"((('0x' || left(sha256(concat_ws('|', {', '.join(parts)})), 13))::BIGINT + 0.5) / 4503599627370496.0)"


def binomial(source: str, n: str, p: str, part: str, name: str) -> str:
    """Tables name_x and name (k, and source's columns, and name): a binomial draw for each row of source."""
    return f"""{name}_x AS MATERIALIZED (SELECT *, {n} AS m, least(coalesce({p}, 0), 1 - coalesce({p}, 0)) AS q, coalesce({p}, 0) > 0.5 AS flipped, {uniform("'42'", "k", f"'{part}'", "'0'")} AS u, {uniform("'42'", "k", f"'{part}'", "'1'")} AS v FROM {source}),
{name}_s AS (SELECT k, count(*) FILTER (upto < u) AS small FROM (SELECT k, u, sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + CASE WHEN i > 0 THEN i * ln(q) ELSE 0 END + (m - i) * ln(1 - q))) OVER (PARTITION BY k ORDER BY i) AS upto
  FROM (SELECT *, unnest(range(0, least(m, 150))) AS i FROM {name}_x WHERE m * q * (1 - q) < 25 AND q > 0)) GROUP BY k),
{name} AS MATERIALIZED (SELECT * EXCLUDE (m, q, flipped, u, v, small, z), CASE WHEN flipped THEN m - c ELSE c END AS {name} FROM (
  SELECT *, CASE WHEN m * q * (1 - q) < 25 THEN coalesce(small, 0) ELSE greatest(0, least(m, round(m * q + sqrt(m * q * (1 - q)) * z + (1 - 2 * q) * (z * z - 1) / 6)::BIGINT)) END AS c
  FROM (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM {name}_x LEFT JOIN {name}_s USING (k))))"""


ORACLES["paired_bootstrap"] = f"""WITH {PREDICTIONS},
d AS (SELECT receipt, max(correct::INT) FILTER (system_id = 'exact') AS a, max(correct::INT) FILTER (system_id = 'noisy') AS b FROM scored WHERE field = 'total_amount' AND correct IS NOT NULL GROUP BY 1),
counts AS MATERIALIZED (SELECT count(*) AS n, count(*) FILTER (a > b) AS up, count(*) FILTER (a < b) AS down FROM d WHERE a IS NOT NULL AND b IS NOT NULL),
draws AS (SELECT unnest(range(1, 2001)) AS k, n, up, down FROM counts),
{binomial("draws", "n", "up::DOUBLE / nullif(n, 0)", "better", "better")},
{binomial("(SELECT * EXCLUDE (c) FROM better)", "n - better", "down::DOUBLE / nullif(n - up, 0)", "worse", "worse")}
SELECT any_value(n) AS n, round(any_value((up - down)::DOUBLE / n), 9) AS difference, round(quantile_cont((better - worse)::DOUBLE / n, 0.025), 9) AS low, round(quantile_cont((better - worse)::DOUBLE / n, 0.975), 9) AS high FROM worse"""


def broken(source: str, key: str, rows: dict[str, str], more: tuple[str, ...] = ()) -> str:
    """Rows that break each rule, their number and smallest key, beside other rules of (rule, n, first_key)."""
    own = [f"SELECT '{name}' AS rule, count(*) AS n, min({key})::VARCHAR AS first_key FROM {source} WHERE {test} HAVING count(*) > 0" for name, test in rows.items()]
    return " UNION ALL ".join([*own, *more])


def repeated(source: str, key: str, rule: str, value: str) -> str:
    return f"SELECT '{rule}', count(*), min(k)::VARCHAR FROM (SELECT min({key}) AS k FROM {source} WHERE {value} IS NOT NULL GROUP BY {value} HAVING count(*) > 1) HAVING count(*) > 0"


ORACLES["receipt_contract"] = """WITH m AS MATERIALIZED (SELECT o_orderkey AS k, CASE WHEN k % 500 <> 7 THEN true END AS authorized, CASE WHEN k % 400 = 3 THEN 'guess' ELSE 'dot_decimal_comma_grouping' END AS policy,
  CASE WHEN k % 300 = 2 THEN 'usd' WHEN k % 3 = 0 THEN 'PHP' ELSE 'unspecified' END AS currency, CASE WHEN k % 200 = 1 THEN 'same:id' WHEN k % 333 = 5 THEN 'no spaces' ELSE 'r:' || k END AS rid,
  CASE WHEN k % 250 = 4 THEN '../' || k || '.png' WHEN k % 251 = 4 THEN k || '.gif' ELSE 'in/' || k || '.JPG' END AS image,
  CASE WHEN k % 600 = 6 THEN 'spare' WHEN k % 100 = 32 THEN 'test' ELSE (['train', 'validation_model', 'test'])[o_custkey % 3 + 1] END AS role, CASE WHEN k % 700 <> 33 THEN 'g' || o_custkey END AS grp FROM orders)
""" + broken("m", "k", {
    "not_authorized": "authorized IS NOT true", "number_format_policy": "policy = 'guess'", "currency": "currency = 'usd'", "bad_receipt_id": "rid = 'no spaces'", "unsafe_image_path": "image LIKE '../%'", "image_type": "image LIKE '%.gif'",
    "role": "role = 'spare'", "no_group": "grp IS NULL",
}, (
    repeated("m", "k", "repeated_receipt_id", "rid"), repeated("m", "k", "repeated_image", "image"), "SELECT 'receipt_count', count(*), NULL FROM m HAVING count(*) NOT BETWEEN 1 AND 1000",
    "SELECT 'group_in_two_roles', count(*), min(k)::VARCHAR FROM (SELECT min(k) AS k FROM m WHERE grp IS NOT NULL GROUP BY grp HAVING count(DISTINCT role) > 1) HAVING count(*) > 0",
    "SELECT 'missing_roles', count(*), NULL FROM (VALUES ('train'), ('validation_model'), ('validation_policy'), ('test')) r(role) WHERE role NOT IN (SELECT role FROM m) HAVING count(*) > 0",
))
ORACLES["annotation_contract"] = f"""WITH {PREDICTIONS}, m AS MATERIALIZED (SELECT receipt AS k, field, raw_text, normalized_amount, CASE WHEN receipt % 19 = 0 THEN 'not_annotated' WHEN receipt % 23 = 0 THEN 'maybe' ELSE 'present' END AS status FROM predictions WHERE system_id = 'noisy')
""" + broken("m", "k", {
    "unknown_field": "k % 41 = 0", "status": "status = 'maybe'", "unsupported_amount": "status = 'present' AND raw_text IS NULL", "contradictory_value": "status = 'present' AND raw_text IS NOT NULL AND k % 29 = 0",
    "value_boxes": "status = 'present' AND (k % 31 = 0 OR k % 37 = 0 OR k % 43 = 0)", "no_provenance": "status = 'present' AND k % 47 = 0",
}, (repeated("(SELECT k, k || '|' || CASE WHEN k % 41 = 0 THEN 'tip_amount' ELSE field END AS f FROM m)", "k", "repeated_field", "f"),))
ORACLES["record_contract"] = f"""WITH m AS MATERIALIZED (SELECT doc_id AS k, {words("text")} AS w, lang, source, CASE WHEN doc_id % 61 = 0 THEN 'again' ELSE doc_id::VARCHAR END AS id FROM documents)
""" + broken("m", "k", {
    "missing_keys": "k IS NULL OR source IS NULL", "question": "k % 59 = 0", "image_size": "k % 71 = 0", "word_count": "len(w) NOT BETWEEN 1 AND 2000", "box_count": "len(w) <> CASE WHEN k % 67 = 0 THEN least(1, len(w)) ELSE len(w) END",
    "box": "len(w) > 0 AND (k % 53 = 0 AND k % 71 <> 0 OR k % 71 = 0 AND (k % 53 = 0 OR len(w) > 5 AND k % 67 <> 0))", "answers": "k % 9 <> 0 AND (k % 73 = 0 OR coalesce(trim(lang), '') = '')",
}, (
    repeated("m", "k", "repeated_id", "id"), "SELECT 'record_count', count(*), NULL FROM m HAVING count(*) NOT BETWEEN 1 AND 500", "SELECT 'page_count', count(DISTINCT source), NULL FROM m HAVING count(DISTINCT source) NOT BETWEEN 1 AND 100",
    "SELECT 'answers_on_some', count(*) FILTER (k % 9 = 0), min(k) FILTER (k % 9 = 0)::VARCHAR FROM m HAVING count(*) FILTER (k % 9 = 0) > 0 AND count(*) FILTER (k % 9 <> 0) > 0",
))


def shuffled(table: str, n: str, seed: int, rounds: int = 6) -> str:
    """Table walked (id, x, step) from table (id, rank): the places of a Feistel shuffle of n ranks, with each walk's steps."""
    a = f"(SELECT (floor(sqrt(greatest(0, n - 1))) + 1)::BIGINT FROM {n})"
    b = f"(SELECT ceil(n::DOUBLE / {a})::BIGINT FROM {n})"

    def once(source: str) -> str:
        inner = f"SELECT id, x % {a} AS l, x // {a} AS r, step FROM {source}"
        for i in range(rounds):
            mixed = f"('0x' || left(md5(concat_ws('|', '{seed}', '{i}', {'r' if i % 2 == 0 else 'l'}::VARCHAR)), 12))::BIGINT"
            cell = f"(l + {mixed}) % {a} AS l, r" if i % 2 == 0 else f"l, (r + {mixed}) % {b} AS r"
            inner = f"SELECT id, {cell}, step FROM ({inner})"
        return f"SELECT id, r * {a} + l AS x, step + 1 AS step FROM ({inner})"

    start, again = once(f"(SELECT id, rank AS x, 0 AS step FROM {table})"), once(f"(SELECT id, x, step FROM walked WHERE x >= (SELECT n FROM {n}))")
    return f"walked(id, x, step) AS ({start} UNION ALL {again})"


ORACLES["sample_splits"] = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT min(doc_id) AS id FROM (SELECT doc_id, list_transform({words("text")}, lambda w: lower(w)) AS k FROM documents) GROUP BY k),
c AS MATERIALIZED (SELECT count(*) AS n FROM d), ranked AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY sha256('rank|' || id)) - 1 AS rank FROM d),
{shuffled("ranked", "c", 42)},
p AS (SELECT id AS page_id, arg_max(x, step) AS place FROM walked GROUP BY id)
SELECT page_id, place, CASE WHEN place < n * 60 // 100 THEN 'train' WHEN place < n * 60 // 100 + n * 15 // 100 THEN 'validation' ELSE 'test' END AS split
FROM p, c WHERE place < n * 60 // 100 + n * 15 // 100 + n * 25 // 100"""

ORACLES["rows_by_place"] = """WITH d AS MATERIALIZED (SELECT doc_id, lang, row_number() OVER () - 1 AS row FROM documents), a AS (SELECT unnest(range(0, (SELECT max(row) FROM d) + 61, 41)) AS row)
SELECT 'documents.parquet' AS file, row, doc_id IS NOT NULL AS found, doc_id, lang FROM a LEFT JOIN d USING (row)"""
ORACLES["exported_references"] = f"WITH {PREDICTIONS} SELECT receipt, field, state, known AS normalized_amount, 'role' || (receipt % 3) AS role FROM refs WHERE receipt % 3 <> 1"

ORACLES["ocr_report"] = f"""WITH c AS ({BASE["ocr_cohort"]}), r AS (SELECT c.*, source FROM c JOIN documents ON doc_id = receipt)
SELECT source, count(*) AS receipts, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'ocr_empty') AS ocr_empty, 0::BIGINT AS ocr_timeout, count(*) FILTER (status = 'ocr_error') AS ocr_error, 0::BIGINT AS image_error,
  count(*) FILTER (n_tokens > 2000) AS over_2000_words, list_sort(list(n_tokens))[count(*) // 2 + 1]::INT AS median_words, max(n_tokens)::INT AS max_words, count(*) FILTER (cached) AS cache_hits FROM r GROUP BY source"""
ORACLES["first_in_hash_order"] = "SELECT page_id, url FROM pages ORDER BY sha256('replay|' || page_id) LIMIT 3"
