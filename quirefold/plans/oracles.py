"""DuckDB SQL of the registered queries."""

from __future__ import annotations

W = r"\p{L}\p{N}_"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def page_runs(key: str, words: str, source: str) -> str:
    """The texts of all runs of at most 20 words of a page, as the tables cleaned and runs (key, run)."""
    return f"""cleaned AS MATERIALIZED (SELECT {key}, list_transform({words}, lambda w: {norm("w")}) AS c FROM {source}),
runs AS MATERIALIZED (SELECT DISTINCT {key}, array_to_string(list_filter(c[i:i + k], lambda w: w <> ''), ' ') AS run
  FROM (SELECT {key}, c, i, unnest(range(0, 20)) AS k FROM (SELECT {key}, c, unnest(range(1, len(c) + 1)) AS i FROM cleaned)))"""


def one_byte(x: str) -> str:
    """Code points above ASCII that occur in the tables, as single bytes: DuckDB's levenshtein counts bytes."""
    odd = "äöüßéèêçñóíáúàâîôûœæ·"
    return f"translate({x}, '{odd}', '{''.join(chr(i) for i in range(1, 1 + len(odd)) if i not in (9, 10, 13))[: len(odd)].ljust(len(odd), chr(127))}')"


def similarity(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({one_byte(a)}, {one_byte(b)})::DOUBLE / greatest(length({a}), length({b})) END"


def wilson(k: str, n: str) -> tuple[str, str]:
    z2 = "(1.959963984540054 * 1.959963984540054)"
    p = f"({k}::DOUBLE / nullif({n}, 0))"
    scale = f"(1 + {z2} / nullif({n}, 0))"
    centre = f"(({p} + {z2} / (2.0 * nullif({n}, 0))) / {scale})"
    half = f"(1.959963984540054 * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {z2} / (4.0 * nullif({n}, 0) * nullif({n}, 0))) / {scale})"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {centre} - {half}) END", f"CASE WHEN {n} > 0 THEN least(1.0, {centre} + {half}) END"


def rate(k: str, n: str) -> str:
    return f"({k})::DOUBLE / nullif({n}, 0)"


def grouped(v: str, style: str) -> str:
    return f"CASE WHEN {style} = 0 THEN replace(format('{{:,}}', {v}), ',', '.') WHEN {style} = 1 THEN format('{{:,}}', {v}) ELSE {v}::VARCHAR END"


RECEIPTS = """
receipts AS MATERIALIZED (
  SELECT o_orderkey AS receipt, o_custkey AS owner, o_orderstatus AS status, (o_orderkey % 3)::INT AS style, subtotal, subtotal // 10 AS tax, subtotal + subtotal // 10 AS total
  FROM orders JOIN (SELECT l_orderkey, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS subtotal FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""

LINES = (
    RECEIPTS
    + f""",
rlines AS (
  SELECT l_orderkey AS receipt, line, 'menu.nm' AS category, line AS group_id,
    ['P' || l_partkey, 'x', (l_quantity::INT)::VARCHAR, {grouped("floor(l_extendedprice)::BIGINT", "(l_orderkey % 3)")}] AS words, 0 AS n_key
  FROM (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INT AS line FROM lineitem) WHERE l_orderkey IN (SELECT receipt FROM receipts)
  UNION ALL SELECT receipt, 100, 'sub_total.subtotal_price', 100, CASE WHEN receipt % 4 = 0 THEN ['Sub', 'Total'] ELSE ['Subtotal:'] END || [{grouped("subtotal", "style")}], CASE WHEN receipt % 4 = 0 THEN 2 ELSE 1 END FROM receipts
  UNION ALL SELECT receipt, 101, 'sub_total.tax_price', 100, ['Tax', CASE WHEN receipt % 7 = 0 THEN '10%' ELSE {grouped("tax", "style")} END], 1 FROM receipts
  UNION ALL SELECT receipt, 102, 'total.total_price', 100, CASE WHEN receipt % 2 = 0 THEN ['TOTAL', 'Rp', {grouped("total", "style")}] ELSE ['TOTAL', {grouped("total", "style")}] END, 1 FROM receipts
  UNION ALL SELECT receipt, 103, 'total.total_price', 100, ['Total', {grouped("(total + receipt % 2)", "style")}], 1 FROM receipts WHERE receipt % 5 = 0),
tokens AS MATERIALIZED (
  SELECT receipt, line, category, group_id, p - 1 AS pos, words[p] AS text, p <= n_key AS is_key, ((p - 1) * 120)::DOUBLE AS x0, (line * 20)::DOUBLE AS y0,
    ((p - 1) * 120 + 10 * length(words[p]))::DOUBLE AS x1, (line * 20 + 16)::DOUBLE AS y1, (50 + (receipt + 7 * line + 3 * (p - 1)) % 50)::DOUBLE AS confidence
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM rlines))"""
)

REFS = (
    RECEIPTS
    + """,
refs AS (
  SELECT receipt, 'subtotal_amount' AS field, 'present_usable' AS state, subtotal::VARCHAR AS known FROM receipts
  UNION ALL SELECT receipt, 'tax_amount', CASE WHEN receipt % 7 = 0 THEN 'not_annotated' ELSE 'present_usable' END, tax::VARCHAR FROM receipts
  UNION ALL SELECT receipt, 'total_amount', CASE WHEN receipt % 5 = 0 AND receipt % 2 = 1 THEN 'ambiguous_reference' ELSE 'present_usable' END, total::VARCHAR FROM receipts)"""
)

PREDICTIONS = (
    REFS
    + f""",
wanted AS MATERIALIZED (
  SELECT *, CASE system_id WHEN 'exact' THEN v WHEN 'lazy' THEN subtotal ELSE CASE WHEN receipt % 6 = 0 THEN v * 10 + 1 ELSE v END END AS value, system_id = 'noisy' AND receipt % 11 = 0 AS gone
  FROM (SELECT receipt, style, subtotal, unnest(['subtotal_amount', 'tax_amount', 'total_amount']) AS field, unnest([subtotal, tax, total]) AS v FROM receipts), (VALUES ('exact', 0), ('noisy', 1), ('lazy', 2)) s(system_id, k)),
predictions AS (
  SELECT system_id, receipt, field, CASE WHEN NOT gone THEN {grouped("value", "style")} END AS raw_text, CASE WHEN gone THEN 'no_candidate' ELSE 'ok' END AS parse_status,
    CASE WHEN NOT gone THEN value::VARCHAR END AS normalized_amount, CASE WHEN NOT gone AND receipt % 13 <> 0 THEN ((receipt * 37 + k * 11) % 100)::DOUBLE / 100 END AS span_score FROM wanted),
scored AS (
  SELECT p.*, state, known, CASE WHEN state = 'present_usable' THEN parse_status = 'ok' AND coalesce(normalized_amount = known, false) END AS correct
  FROM predictions p JOIN refs USING (receipt, field)),
totals AS (SELECT * FROM scored WHERE field = 'total_amount')"""
)

SWEEP = (
    PREDICTIONS
    + """,
base AS (SELECT system_id, count(correct) AS scoreable FROM totals GROUP BY 1),
eligible AS (SELECT system_id, span_score, correct FROM totals WHERE correct IS NOT NULL AND parse_status = 'ok' AND span_score IS NOT NULL),
steps AS (SELECT system_id, span_score AS threshold, count(*) AS k, count(*) FILTER (correct) AS good FROM eligible GROUP BY 1, 2),
sums AS (
  SELECT system_id, threshold, sum(k) OVER w AS accepted, sum(good) OVER w AS good, threshold = min(threshold) OVER (PARTITION BY system_id) AS lowest
  FROM steps WINDOW w AS (PARTITION BY system_id ORDER BY threshold DESC)),
swept AS (
  SELECT system_id, CASE WHEN lowest THEN 'accept_all_eligible' ELSE 'observed_score' END AS kind, threshold, accepted::BIGINT AS accepted, scoreable, accepted::DOUBLE / nullif(scoreable, 0) AS coverage,
    good::DOUBLE / nullif(accepted, 0) AS accuracy, (accepted - good)::BIGINT AS errors FROM sums JOIN base USING (system_id)
  UNION ALL SELECT system_id, 'refer_all', NULL, 0, scoreable, 0.0 / nullif(scoreable, 0), NULL, 0 FROM base)"""
)


#: The rule system's result by the receipts' construction: where its keys and amounts stand, and which of them mislead.
RULED = (
    LINES
    + f""",
f AS (SELECT receipt, unnest(['subtotal_amount', 'tax_amount', 'total_amount']) AS field, unnest([subtotal, tax, total]) AS v, style FROM receipts),
p AS (SELECT *, CASE field WHEN 'subtotal_amount' THEN 100 WHEN 'tax_amount' THEN 101 ELSE 102 END AS line FROM f),
s AS (SELECT *, CASE WHEN field = 'tax_amount' AND receipt % 7 = 0 THEN 'below' WHEN field = 'total_amount' AND receipt % 5 = 0 AND receipt % 2 = 1 THEN 'ambiguous' ELSE 'ok' END AS how FROM p),
c AS (SELECT s.receipt, s.field, how, v, style, min(t.confidence) FILTER (t.is_key OR t.text = 'Rp' OR regexp_matches(t.text, '^[0-9.,]+$')) AS own FROM s JOIN tokens t ON t.receipt = s.receipt AND t.line = s.line GROUP BY 1, 2, 3, 4, 5),
under AS (SELECT receipt, max(text) FILTER (pos = (CASE WHEN receipt % 2 = 0 THEN 2 ELSE 1 END)) AS text, min(confidence) FILTER (pos >= 1) AS conf FROM tokens WHERE line = 102 GROUP BY 1),
keyc AS (SELECT receipt, confidence FROM tokens WHERE line = 101 AND pos = 0),
base AS (SELECT l_orderkey AS receipt, 4 * count(*) AS b100, 4 * count(*) + CASE WHEN l_orderkey % 4 = 0 THEN 3 ELSE 2 END AS b101 FROM lineitem GROUP BY l_orderkey),
ids AS (SELECT receipt, b100, b101, b101 + 2 AS b102, b101 + 2 + CASE WHEN receipt % 2 = 0 THEN 3 ELSE 2 END AS b103,
  CASE WHEN receipt % 2 = 0 THEN (b101 + 3) || ',' || (b101 + 4) ELSE (b101 + 3)::VARCHAR END AS totals FROM base),
ruled AS (
  SELECT c.receipt, field, CASE WHEN how = 'ambiguous' THEN 'ambiguous' ELSE 'ok' END AS parse_status,
    CASE how WHEN 'ok' THEN CASE WHEN field = 'total_amount' AND c.receipt % 2 = 0 THEN 'Rp ' ELSE '' END || {grouped("v", "style")} WHEN 'below' THEN CASE WHEN c.receipt % 2 = 0 THEN 'Rp ' || under.text ELSE under.text END END AS raw_text,
    CASE how WHEN 'ok' THEN v::VARCHAR WHEN 'below' THEN regexp_replace(under.text, '[.,]', '', 'g') END AS normalized_amount,
    CASE how WHEN 'ok' THEN own / 100 WHEN 'below' THEN least(keyc.confidence, under.conf) / 100 END AS span_score,
    CASE WHEN how = 'ambiguous' THEN 'tied_distinct_candidates' ELSE '' END AS reasons,
    CASE WHEN how = 'ambiguous' THEN '' WHEN how = 'below' OR field = 'total_amount' THEN totals WHEN field = 'tax_amount' THEN (b101 + 1)::VARCHAR ELSE (b101 - 1)::VARCHAR END AS token_ids,
    CASE WHEN how = 'ambiguous' THEN '' WHEN field = 'total_amount' THEN b102::VARCHAR WHEN field = 'tax_amount' THEN b101::VARCHAR WHEN c.receipt % 4 = 0 THEN b100 || ',' || (b100 + 1) ELSE b100::VARCHAR END AS key_token_ids,
    CASE WHEN field = 'total_amount' AND c.receipt % 5 = 0 THEN 2 ELSE 1 END AS candidate_count,
    CASE WHEN how = 'ambiguous' THEN (b102 + 1) || ',' || (b103 + 1) ELSE '' END AS candidate_token_ids
  FROM c JOIN under USING (receipt) JOIN keyc USING (receipt) JOIN ids USING (receipt))"""
)

#: Where the words of a field's own lines show its amount; longer runs hold a shorter one, other lines overlap no region.
ALIGNED = (
    LINES
    + """,
""" + REFS.partition("refs AS")[1] + REFS.partition("refs AS")[2] + """,
shown AS (
  SELECT t.receipt, field, count(*) AS n, min(line) AS line, min(pos) AS pos FROM tokens t
  JOIN refs r ON r.receipt = t.receipt AND state = 'present_usable' AND t.category = CASE field WHEN 'subtotal_amount' THEN 'sub_total.subtotal_price' WHEN 'tax_amount' THEN 'sub_total.tax_price' ELSE 'total.total_price' END
  WHERE NOT is_key AND regexp_matches(text, '^[0-9.,]+$') AND regexp_replace(text, '[.,]', '', 'g') = known GROUP BY 1, 2),
aligned AS (
  SELECT receipt, field, status, spans, CASE WHEN spans = 1 THEN line END AS line, CASE WHEN spans = 1 THEN pos END AS start, CASE WHEN spans = 1 THEN pos END AS "end",
    CASE status WHEN 'no_usable_reference' THEN 'not_scoreable' WHEN 'aligned' THEN 'recoverable' WHEN 'ambiguous_alignment' THEN 'recoverable_ambiguous' ELSE 'not_recoverable' END AS recoverable
  FROM (SELECT r.receipt, r.field, coalesce(n, 0) AS spans, line, pos, CASE WHEN state <> 'present_usable' THEN 'no_usable_reference' WHEN n IS NULL THEN 'target_not_recoverable_from_ocr' WHEN n = 1 THEN 'aligned' ELSE 'ambiguous_alignment' END AS status
    FROM refs r LEFT JOIN shown USING (receipt, field)))"""
)

def point(coverage: float) -> str:
    return f"""SELECT system_id, {coverage}::DOUBLE AS requested_coverage, hi IS NOT NULL AS reached_requested, threshold, accepted, scoreable, coverage, accuracy, errors,
  CASE WHEN threshold IS NULL THEN 'refer_all' ELSE 'coverage_operating_point' END AS selected_state
  FROM swept JOIN (SELECT system_id, max(threshold) FILTER (coverage >= {coverage}) AS hi, min(threshold) AS lo FROM swept GROUP BY 1) USING (system_id)
  WHERE threshold IS NOT DISTINCT FROM coalesce(hi, lo)"""


def amounts(groups: str, decimals: str) -> str:
    def esc(c: str) -> str:
        return rf"\{c}"

    g = {c: rf"\d{{1,3}}({esc(c)}\d{{3}})+" for c in groups}
    whole = "^(" + "|".join([r"\d+", *g.values()]) + ")$"
    cents = "^(" + "|".join(rf"({'|'.join([r'\d+', *(v for c, v in g.items() if c != d)])}){esc(d)}\d\d" for d in decimals) + ")$"
    mark = r"(?i)^(rp\.?|idr|php|₱)\s*"
    return rf"""
WITH {LINES},
strings AS (
  SELECT DISTINCT unnest([text, 'Rp. ' || text, '-' || text, text || '%', '0' || text || '.50', text || ',00', '1 ' || text]) AS s FROM (SELECT DISTINCT text FROM tokens)
  UNION SELECT DISTINCT unnest({words("text")}) FROM documents),
b0 AS (SELECT s, trim(regexp_replace(s, '\s+', ' ', 'g')) AS body0 FROM strings),
b AS (SELECT s, body0, lower(regexp_extract(body0, '{mark}', 1)) AS mark, regexp_replace(body0, '{mark}', '') AS body FROM b0),
c AS (
  SELECT *, regexp_matches(body, '{whole}') AS whole, regexp_matches(body, '{cents}') AS cents,
    CASE WHEN body0 = '' THEN 'no_candidate|' WHEN body = '' THEN 'parse_failed|currency_marker_only' WHEN contains(body, '%') THEN 'unsupported|percentage'
      WHEN regexp_matches(body, '^[-+(−]|[-)]$|−') THEN 'unsupported|sign_or_refund' WHEN contains(body, ' ') THEN 'ambiguous|multiple_or_spaced_amounts'
      WHEN NOT regexp_matches(body, '^[0-9.,]+$') THEN 'parse_failed|non_numeric_characters'
      WHEN NOT (regexp_matches(body, '{whole}') OR regexp_matches(body, '{cents}')) THEN 'ambiguous|separator_grammar' ELSE 'ok|' END AS outcome FROM b),
d AS (SELECT *, regexp_replace(CASE WHEN cents THEN left(body, length(body) - 3) ELSE body END, '[.,]', '', 'g') AS digits, CASE WHEN cents THEN right(body, 2) END AS fraction FROM c),
e AS (SELECT *, CASE WHEN ltrim(digits, '0') = '' THEN '0' ELSE ltrim(digits, '0') END AS whole_part FROM d)
SELECT s, split_part(outcome, '|', 1) AS parse_status, CASE WHEN outcome = 'ok|' THEN CASE WHEN fraction IS NULL OR fraction = '00' THEN whole_part ELSE whole_part || '.' || fraction END END AS normalized_amount,
  CASE WHEN starts_with(mark, 'rp') OR mark = 'idr' THEN 'IDR' WHEN mark IN ('php', '₱') THEN 'PHP' ELSE 'unspecified' END AS currency, nullif(split_part(outcome, '|', 2), '') AS reason FROM e
"""


LOOKUP = rf"""
asked AS MATERIALIZED (SELECT doc_id AS page_id, lang, {words("d.text")} AS words, b.text AS question FROM documents d JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
content AS (SELECT page_id, unnest(list_distinct(list_filter(string_split({norm("question")}, ' '), lambda w: w <> '' AND w NOT IN ('what', 'is', 'the', 'how', 'much', 'many', 'was', 'were', 'paid', 'given', 'by', 'of', 'name', 'first', 'item', 'items', 'bought', 'amount', 'charge')))) AS q FROM asked),
heads AS (SELECT DISTINCT page_id, left(q, k) AS p FROM (SELECT page_id, q, unnest(range(3, length(q) + 1)) AS k FROM content)),
pwords AS MATERIALIZED (SELECT page_id, i AS idx, words[i] AS w FROM (SELECT page_id, words, unnest(range(1, len(words) + 1)) AS i FROM asked)),
pnorm AS (SELECT page_id, idx, w, {norm("w")} AS n FROM pwords),
pheads AS (SELECT page_id, idx, left(n, k) AS p FROM (SELECT page_id, idx, n, unnest(range(3, length(n) + 1)) AS k FROM pnorm)),
best AS (SELECT page_id, (max(struct_pack(n := length(p), idx := idx))).idx AS found FROM pheads JOIN heads USING (page_id, p) GROUP BY 1),
later AS (SELECT page_id, arg_min(w, idx) AS w FROM pwords JOIN best USING (page_id) WHERE idx > found AND regexp_matches(w, '\p{{Nd}}') GROUP BY 1),
last AS (SELECT page_id, arg_max(w, idx) AS w FROM pwords WHERE regexp_matches(w, '\p{{Nd}}') GROUP BY 1),
answers AS (SELECT asked.page_id, lang, coalesce(later.w, last.w, '') AS answer, coalesce(last.w, '') AS gold FROM asked LEFT JOIN later USING (page_id) LEFT JOIN last USING (page_id))"""

RULES = (
    LINES
    + rf""",
keyed AS (SELECT *, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS t FROM tokens),
phrases AS (SELECT phrase, category, count(*) AS n FROM (SELECT receipt, line, category, string_agg(t, ' ' ORDER BY pos) AS phrase FROM keyed WHERE is_key AND t <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
top AS (SELECT phrase, category, n, sum(n) OVER (PARTITION BY phrase) AS total, row_number() OVER (PARTITION BY phrase ORDER BY n DESC, category) AS r FROM phrases),
rules AS (
  SELECT CASE category WHEN 'sub_total.subtotal_price' THEN 'subtotal_amount' WHEN 'sub_total.tax_price' THEN 'tax_amount' ELSE 'total_amount' END AS field, phrase, n::BIGINT AS support, n::DOUBLE / total AS purity
  FROM top WHERE r = 1 AND category IN ('sub_total.subtotal_price', 'sub_total.tax_price', 'total.total_price') AND total >= 3 AND n::DOUBLE / total >= 0.8)"""
)


def oracles() -> dict[str, str]:
    n, m = norm("text"), norm("next_text")
    said = grouped("total", "style")
    golds = f"[{grouped('total', '0')}, {grouped('total', '2')}, {grouped('subtotal', '1')}]"
    lo, hi = wilson("good", "n")
    em_lo, em_hi = wilson("correct", "usable")
    acc_lo, acc_hi = wilson("(accepted - errors)", "accepted")
    err_lo, err_hi = wilson("unflagged_wrong", "unflagged_scored")
    name = "CASE category WHEN 'sub_total.subtotal_price' THEN 'subtotal_amount' WHEN 'sub_total.tax_price' THEN 'tax_amount' WHEN 'total.total_price' THEN 'total_amount' END"
    turns = "turns AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)"
    out = {
        "normalize_answer": rf"SELECT doc_id, {n} AS normalized, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed FROM documents",
        "turn_similarity": f"""WITH {turns}, p AS (SELECT conv_id, turn, {n} AS a, {m} AS b FROM turns WHERE next_text IS NOT NULL), q AS (SELECT *, levenshtein({one_byte("a")}, {one_byte("b")}) AS distance, {similarity("a", "b")} AS s FROM p)
SELECT conv_id, turn, distance::INT AS distance, round(CASE WHEN s >= 0.5 THEN s ELSE 0.0 END, 9) AS anls, a = b AS exact FROM q""",
        "best_of_golds": f"""WITH {RECEIPTS}, p AS (SELECT receipt, {said} AS said, unnest({golds}) AS gold FROM receipts), q AS (SELECT receipt, said, {norm("said")} AS a, {norm("gold")} AS b FROM p),
r AS (SELECT receipt, said, max({similarity("a", "b")}) AS s, bool_or(a = b) AS exact FROM q GROUP BY 1, 2) SELECT receipt, said, round(CASE WHEN s >= 0.5 THEN s ELSE 0.0 END, 9) AS anls, exact FROM r""",
        "last_number": rf"""SELECT doc_id AS page_id, coalesce(list_filter(w, lambda x: regexp_matches(x, '\p{{Nd}}'))[-1], '') AS answer, len(w)::INT AS n_words FROM (SELECT doc_id, {words("text")} AS w FROM documents)""",
        "keyword_lookup": f"WITH {LOOKUP} SELECT page_id, answer FROM answers",
        "keyword_baseline": f"""WITH {LOOKUP}, p AS (SELECT lang, answer, {norm("answer")} AS a, {norm("gold")} AS b FROM answers), q AS (SELECT lang, answer, a = b AS exact, {similarity("a", "b")} AS s FROM p)
SELECT lang, count(*) AS n, round(avg(CASE WHEN s >= 0.5 THEN s ELSE 0.0 END), 9) AS anls, round(avg(exact::INT), 9) AS exact_match, round(avg((trim(answer) = '')::INT), 9) AS empty_rate, count(*) >= 50 AS enough FROM q GROUP BY lang""",
        "answer_on_page": f"""WITH {turns}, w AS (SELECT *, {words("text")} AS ws FROM turns), s AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN array_to_string(ws[3:8], ' ') ELSE coalesce(next_text, '') END AS said FROM w),
{page_runs("conv_id, turn", "ws", "w")}
SELECT conv_id, turn, {norm("said")} <> '' AND run IS NOT NULL AS found FROM s LEFT JOIN runs ON (runs.conv_id, runs.turn, run) = (s.conv_id, s.turn, {norm("said")})""".replace("SELECT conv_id, turn, trim", "SELECT s.conv_id, s.turn, trim"),
        "spreadsheet_safe": r"""WITH r AS (SELECT doc_id, source, (['=', '+', ' @', chr(9), '', '-'])[doc_id % 6 + 1] || text AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '^\s*[=+\-@]') OR regexp_matches(t, '^[\t\r\n]') THEN chr(39) || t ELSE t END AS cell, format('{}-{:04d}', source, doc_id) AS name FROM r""",
        "page_key": f"SELECT min(doc_id) AS page_id FROM (SELECT doc_id, list_transform({words('text')}, lambda w: lower(w)) AS k FROM documents) GROUP BY k",
        "quality_rates": f"""WITH g AS (SELECT source, count(quality) AS n, coalesce(sum(quality), 0)::BIGINT AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n, good, round({rate("good", "n")}, 9) AS rate, round({lo}, 9) AS low, round({hi}, 9) AS high, CASE WHEN n >= 50 THEN 'measured' WHEN n >= 10 THEN 'measured-small-sample' ELSE 'too_few_to_read' END AS verdict FROM g""",
        "tolerance": """WITH p AS (SELECT l_returnflag, l_linenumber % 4 AS k, l_extendedprice * (1 - l_discount) AS price FROM lineitem),
q AS (SELECT l_returnflag, price, CASE k WHEN 0 THEN NULL WHEN 1 THEN price * 1.000004::DOUBLE WHEN 2 THEN price * 1.1::DOUBLE ELSE price END AS near FROM p)
SELECT l_returnflag, CASE WHEN near IS NULL OR price IS NULL THEN near IS NULL AND price IS NULL ELSE abs(near - price) <= 1e-6 + 1e-5 * abs(price) END AS close, near IS NOT NULL AS finite, count(*) AS n FROM q GROUP BY 1, 2, 3""",
        "target_sizes": "SELECT source, count(*) AS n, greatest(1, round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT) AS n_test, round_even(count(*) * 0.15::DOUBLE, 0)::BIGINT AS n_validation FROM documents GROUP BY source",
        "digests": "SELECT page_id, sha256(html) AS sha256, sha1(encode('blob ' || strlen(html)) || '\\x00'::BLOB || encode(html)) AS blob, strlen(html)::BIGINT AS n_bytes FROM pages",
        "hash_order": "SELECT page_id, row_number() OVER (ORDER BY sha256('replay|' || page_id)) - 1 AS rank FROM pages",
        "box_grid": f"""WITH {LINES}, b AS (SELECT *, receipt % 8 + 1 AS k, least(3, floor((x0 + x1) / 2 / 250)) AS c, least(7, floor((y0 + y1) / 2 / 312.5)) AS r FROM tokens),
t AS (SELECT *, CASE k WHEN 1 THEN [x0, y0, x1, y1] WHEN 2 THEN [1000 - x1, y0, 1000 - x0, y1] WHEN 3 THEN [1000 - x1, 2500 - y1, 1000 - x0, 2500 - y0] WHEN 4 THEN [x0, 2500 - y1, x1, 2500 - y0]
  WHEN 5 THEN [y0, x0, y1, x1] WHEN 6 THEN [2500 - y1, x0, 2500 - y0, x1] WHEN 7 THEN [2500 - y1, 1000 - x1, 2500 - y0, 1000 - x0] ELSE [y0, 1000 - x1, y1, 1000 - x0] END AS t FROM b)
SELECT receipt, line, pos::INT AS pos, trunc(1000 * (x0 / 1000))::INT AS g0, trunc(1000 * (y0 / 2500))::INT AS g1, trunc(1000 * (x1 / 1000))::INT AS g2, trunc(1000 * (y1 / 2500))::INT AS g3, t[1] AS t0, t[2] AS t1, t[3] AS t2, t[4] AS t3,
  c * 250.0::DOUBLE AS c0, r * 312.5::DOUBLE AS c1, (c + 1) * 250.0::DOUBLE AS c2, (r + 1) * 312.5::DOUBLE AS c3, x0 < x1 AND y0 < y1 AND x0 >= 0 AND y0 >= 0 AND x1 <= 1000 AND y1 <= 2500 AS valid FROM t""",
        "box_overlap": f"""WITH {LINES}, u AS (SELECT receipt, line, min(x0) + 25 AS a0, min(y0) + 4 AS b0, max(x1) AS a1, max(y1) AS b1 FROM tokens GROUP BY 1, 2)
SELECT receipt, line, pos::INT AS pos, round(CASE WHEN (x1 - x0) * (y1 - y0) <= 0 THEN 0.0 ELSE greatest(0.0, least(x1, a1) - greatest(x0, a0)) * greatest(0.0, least(y1, b1) - greatest(y0, b0)) / ((x1 - x0) * (y1 - y0)) END, 9) AS share FROM tokens JOIN u USING (receipt, line)""",
        "page_violations": rf"""WITH p AS (SELECT doc_id, text, {words("text")} AS w FROM documents), q AS (SELECT *, len(w) - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS width, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM p),
v AS (SELECT doc_id AS page_id, CASE WHEN len(w) = 0 THEN 'no_words' WHEN len(w) > 2000 THEN 'too_many_words' WHEN width NOT BETWEEN 1 AND 10000 THEN 'bad_image_size' WHEN width < len(w) OR list_max(list_transform(w, lambda x: length(x))) > 40 THEN 'bad_box' END AS violation,
  CASE WHEN t = '' THEN 'blank_question' WHEN length(t) > 256 THEN 'long_question' END AS question FROM q) SELECT * FROM v WHERE violation IS NOT NULL OR question IS NOT NULL""",
        "record_violations": f"""WITH p AS (SELECT doc_id, {words("text")} AS w FROM documents), q AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 13 = 0 THEN 'bad_id' WHEN doc_id % 7 + doc_id % 3 >= len(w) THEN 'span_outside' WHEN doc_id % 10 = 0 THEN 'answer_mismatch' END AS violation FROM p)
SELECT * FROM q WHERE violation IS NOT NULL""",
        "dataset_report": f"""WITH p AS (SELECT *, len({words("text")}) AS n FROM documents) SELECT lang, count(*) AS records, min(n)::INT AS min_words, max(n)::INT AS max_words, max(length(text))::INT AS max_chars, count(DISTINCT source) AS sources, count(DISTINCT text) AS contents FROM p GROUP BY lang""",
        "repeated_ids": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
        "receipt_failures": f"""WITH p AS (SELECT doc_id, len({words("text")}) AS n FROM documents) SELECT doc_id AS page_id, CASE WHEN doc_id % 17 = 0 THEN 'ocr_timeout' WHEN n = 0 THEN 'ocr_empty' WHEN n > 2000 THEN 'input_limit_exceeded' WHEN doc_id % 23 = 0 THEN 'invalid_geometry' END AS failure FROM p""",
        "crossing_groups": "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS roles FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
        "all_or_none": "SELECT source, count(quality) AS present, count(*) AS n, count(quality) IN (0, count(*)) AS consistent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
        "unsafe_paths": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), 'html$', '..') AS path FROM pages)
SELECT page_id, path, path IS NULL OR path = '' OR starts_with(path, '/') OR contains(path, '\') OR contains(path, ':') OR len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) > 0 AS unsafe FROM p""",
        "manifest_conflicts": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.source IS NULL THEN 'only_in_split' WHEN l.doc_id IS NULL THEN 'only_in_data' ELSE 'role_differs' END AS problem
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.source IS NULL OR l.doc_id IS NULL OR d.source <> 'src' || (l.doc_id % 20)""",
        "missing_parts": """SELECT part, 'left' AS side FROM (SELECT p_partkey + 3 AS part FROM part EXCEPT SELECT l_partkey FROM lineitem) UNION ALL SELECT part, 'right' FROM (SELECT l_partkey AS part FROM lineitem EXCEPT SELECT p_partkey + 3 FROM part)""",
        "half_split": "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY sha256('half|' || o_orderkey)) - 1 < (SELECT count(*) // 2 FROM orders) THEN 'validation_policy' ELSE 'validation_model' END AS role FROM orders",
        "duplicate_families": """WITH f AS (SELECT text, count(*) AS members, min(doc_id) AS first, count(DISTINCT lang) > 1 AS mixed FROM documents GROUP BY text HAVING count(*) > 1)
SELECT doc_id, sha256(text) AS family, members, CASE WHEN mixed THEN 'quarantined' WHEN doc_id = first THEN 'kept' ELSE 'excluded' END AS verdict FROM documents JOIN f USING (text)""",
        "greedy_split": """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT greatest(1, round_even(sum(n) * 0.2::DOUBLE, 0)) AS t, round_even(sum(n) * 0.15::DOUBLE, 0) AS v FROM g),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sha256('split|' || o_custkey) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), s AS (SELECT sum(n) AS used FROM r, t WHERE before < t)
SELECT o_custkey, n, CASE WHEN before < t THEN 'test' WHEN before - used < v THEN 'validation' ELSE 'train' END AS split FROM r, t, s""",
        "split_overlaps": "SELECT sha256(text) AS content, string_agg(DISTINCT source, ',' ORDER BY source) AS splits FROM documents GROUP BY text HAVING count(DISTINCT source) > 1",
        "annotated_words": f"""WITH {LINES}, k AS (SELECT * FROM tokens WHERE NOT (receipt % 3 = 0 AND line = 1 AND pos = 1) AND NOT (receipt % 3 = 1 AND line = 1 AND pos = 2) AND least(1000, x1) > x0 AND least(2500, y1) > y0)
SELECT receipt, (dense_rank() OVER (PARTITION BY receipt ORDER BY line) - 1)::INT AS line, category, (row_number() OVER (PARTITION BY receipt ORDER BY line, pos) - 1)::INT AS pos, text, is_key, least(1000.0, x1) AS x1, least(2500.0, y1) AS y1 FROM k""",
        "page_questions": f"""WITH {LINES}, k AS (SELECT * FROM tokens WHERE NOT (receipt % 3 = 0 AND line = 1 AND pos = 1) AND NOT (receipt % 3 = 1 AND line = 1 AND pos = 2) AND least(1000, x1) > x0 AND least(2500, y1) > y0),
w AS (SELECT *, row_number() OVER (PARTITION BY receipt ORDER BY line, pos) - 1 AS idx FROM k),
l AS (SELECT receipt, line, category, group_id, min(idx) AS start, arg_min(y0, idx) AS top, min(idx) FILTER (NOT is_key) AS v0, max(idx) FILTER (NOT is_key) AS v1, count(*) FILTER (NOT is_key) AS n, string_agg(text, ' ' ORDER BY idx) FILTER (NOT is_key) AS answer FROM w GROUP BY 1, 2, 3, 4),
c AS (SELECT *, count(*) OVER (PARTITION BY receipt, category) AS in_category, count(*) OVER (PARTITION BY receipt, category, group_id) AS in_group, row_number() OVER (PARTITION BY receipt, category ORDER BY top, start) AS r FROM l),
q(field, question, template) AS (VALUES ('total.total_price', 'What is the total amount?', 0), ('sub_total.subtotal_price', 'What is the subtotal?', 1), ('sub_total.tax_price', 'What is the tax amount?', 2), ('menu.nm', 'What is the name of the first item?', 9))
SELECT receipt, field, question, template, v0::INT AS answer_start, v1::INT AS answer_end, answer FROM c JOIN q ON field = category WHERE r = 1 AND n > 0 AND v1 - v0 + 1 = n AND CASE WHEN category = 'menu.nm' THEN in_group = 1 ELSE in_category = 1 END""",
        "keyword_rules": f"WITH {RULES} SELECT field, phrase, support, round(purity, 9) AS purity FROM rules",
        "reference_states": f"""WITH {LINES}, v AS (SELECT receipt, category, line, string_agg(text, ' ' ORDER BY pos) FILTER (NOT is_key) AS said FROM tokens WHERE category <> 'menu.nm' GROUP BY 1, 2, 3),
a AS (SELECT receipt, {name} AS field, said = '10%' AS bad, regexp_replace(regexp_replace(said, '^Rp ', ''), '[.,]', '', 'g') AS value FROM v),
g AS (SELECT receipt, field, bool_or(bad) AS bad, min(value) AS lo, max(value) AS hi, count(*) AS n_lines FROM a GROUP BY 1, 2)
SELECT receipt, field, CASE WHEN reason IS NULL THEN 'present_usable' ELSE 'ambiguous_reference' END AS state, reason, CASE WHEN reason IS NULL THEN lo END AS normalized_amount, n_lines FROM (
  SELECT *, CASE WHEN field <> 'total_amount' AND receipt % 31 = 0 THEN 'sub_total_alias_conflict' WHEN bad THEN 'unparseable_source_value' WHEN lo <> hi THEN 'multiple_incompatible_values'
    WHEN field = 'total_amount' AND receipt % 37 <> 0 AND receipt % 41 = 0 THEN 'structured_gt_parse_value' WHEN field = 'total_amount' AND receipt % 37 <> 0 AND receipt % 41 <> 0 AND receipt % 43 = 0 THEN 'gt_parse_value_word_disagreement' END AS reason FROM g)""",
        "rule_extraction": f"WITH {RULED} SELECT * FROM ruled",
        "rule_scores": f"""WITH {RULED}, {REFS.partition("refs AS")[1]}{REFS.partition("refs AS")[2]}
SELECT field, parse_status, state, count(*) AS n, count(*) FILTER (state = 'present_usable' AND parse_status = 'ok' AND normalized_amount = known) AS correct FROM ruled JOIN refs USING (receipt, field) GROUP BY 1, 2, 3""",
        "span_alignment": f"WITH {ALIGNED} SELECT * FROM aligned",
        "recoverability_rates": f"""WITH {ALIGNED}, {PREDICTIONS.partition("wanted AS")[1]}{PREDICTIONS.partition("wanted AS")[2]},
r AS (SELECT system_id, field, starts_with(recoverable, 'recoverable') AS there, s.correct FROM scored s JOIN aligned USING (receipt, field) WHERE s.correct IS NOT NULL),
g AS (SELECT system_id, field, count(*) AS scoreable, count(*) FILTER (there) AS recoverable, count(*) FILTER (there AND correct) AS good FROM r GROUP BY 1, 2)
SELECT system_id, field, scoreable, recoverable, round({rate("recoverable", "scoreable")}, 9) AS share, round({rate("good", "recoverable")}, 9) AS em FROM g""",
        "system_metrics": f"""WITH {PREDICTIONS}, g AS (SELECT system_id, field, count(*) AS receipts, count(correct) AS usable, count(*) FILTER (correct) AS correct, count(*) FILTER (coalesce(raw_text, '') <> '') AS c, count(*) FILTER (parse_status = 'ok') AS p,
  count(*) FILTER (state = 'not_annotated' AND parse_status = 'ok') AS unscored FROM scored GROUP BY 1, 2)
SELECT system_id, field, receipts, usable, correct, round({rate("correct", "usable")}, 9) AS em, round({em_lo}, 9) AS em_low, round({em_hi}, 9) AS em_high, round({rate("c", "receipts")}, 9) AS candidate_coverage, round({rate("p", "receipts")}, 9) AS parse_coverage, unscored FROM g""",
        "macro_scores": f"""WITH {PREDICTIONS}, e AS (SELECT system_id, field, avg(correct::INT) AS em FROM scored WHERE correct IS NOT NULL GROUP BY 1, 2), m AS (SELECT system_id, avg(em) AS field_macro_em, count(*) AS contributors FROM e GROUP BY 1),
r AS (SELECT system_id, receipt, bool_or(field = 'total_amount' AND correct IS NOT NULL) AS has, bool_and(correct) AS ok FROM scored GROUP BY 1, 2), a AS (SELECT system_id, count(*) AS receipts, count(*) FILTER (ok) AS matching FROM r WHERE has GROUP BY 1)
SELECT system_id, round(field_macro_em, 9) AS field_macro_em, contributors, receipts, matching, round({rate("matching", "receipts")}, 9) AS share FROM m JOIN a USING (system_id)""",
        "metrics_rollup": f"WITH {PREDICTIONS} SELECT system_id, field, count(correct) AS usable, round(avg(correct::INT), 9) AS em FROM scored GROUP BY ROLLUP (system_id, field)",
        "state_crosstab": f"WITH {REFS} SELECT field, count(*) FILTER (state = 'present_usable') AS present_usable, count(*) FILTER (state = 'not_annotated') AS not_annotated, count(*) FILTER (state = 'ambiguous_reference') AS ambiguous_reference FROM refs GROUP BY field",
        "reason_strings": "SELECT user_id, string_agg(event_type || '=' || n, '; ' ORDER BY event_type || '=' || n) AS reasons FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id",
        "ocr_summary": f"""WITH p AS (SELECT source, len({words("text")}) AS n FROM documents) SELECT source, count(*) AS n, list_sort(list(n))[count(*) // 2 + 1]::BIGINT AS upper_median, max(n)::BIGINT AS most FROM p GROUP BY source""",
        "latencies": "SELECT event_type, count(value) AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.95), 9) AS p95, round(max(value), 9) AS most FROM events GROUP BY event_type",
        "system_agreement": f"""WITH {PREDICTIONS}, a AS (SELECT receipt, field, coalesce(correct, false) AS a FROM scored WHERE system_id = 'exact'), b AS (SELECT receipt, field, coalesce(correct, false) AS b FROM scored WHERE system_id = 'noisy')
SELECT field, CASE WHEN a AND b THEN 'both_exact' WHEN a THEN 'exact_only' WHEN b THEN 'noisy_only' ELSE 'neither_exact' END AS category, count(*) AS n FROM a JOIN b USING (receipt, field) GROUP BY 1, 2""",
        "system_disagreements": f"""WITH {PREDICTIONS}, d AS (SELECT receipt, field, a.raw_text AS first, b.raw_text AS second FROM predictions a JOIN predictions b USING (receipt, field) WHERE a.system_id = 'exact' AND b.system_id = 'lazy') SELECT * FROM d WHERE {norm("first")} <> {norm("second")}""",
        "answer_stability": f"""WITH {PREDICTIONS}, d AS (SELECT field, {norm("a.raw_text")} = {norm("b.raw_text")} AS same, a.span_score AS s0, b.span_score AS s1 FROM predictions a JOIN predictions b USING (receipt, field) WHERE a.system_id = 'exact' AND b.system_id = 'noisy')
SELECT field, count(*) AS n, count(*) FILTER (same) AS same, round(avg(same::INT), 9) AS rate, round(avg(s0), 9) AS before, round(avg(s1), 9) AS after, round(avg(s1) - avg(s0), 9) AS delta FROM d GROUP BY field""",
        "policy_sweep": f"WITH {SWEEP} SELECT system_id, kind, threshold, accepted, scoreable, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy, errors FROM swept",
        "policy_selection": f"""WITH {SWEEP}, m AS (SELECT *, coalesce(threshold IS NOT NULL AND accuracy >= 0.95 AND coverage >= 0.5 AND accepted >= 25, false) AS ok FROM swept),
b AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ok DESC, coverage DESC, errors::DOUBLE / nullif(accepted, 0), threshold DESC) AS r FROM m WHERE ok OR kind = 'refer_all')
SELECT system_id, ok AS policy_feasible, kind, threshold, accepted, scoreable, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy, errors, round({acc_lo}, 9) AS accuracy_low, round({acc_hi}, 9) AS accuracy_high FROM b WHERE r = 1""",
        "coverage_points": f"WITH {SWEEP}, c AS ({point(0.3)} UNION ALL {point(1.0)}) SELECT * REPLACE (round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy) FROM c",
        "review_metrics": f"""WITH {SWEEP}, c AS ({point(0.3)}), r AS (SELECT t.*, parse_status = 'ok' AND span_score IS NOT NULL AND coalesce(span_score >= threshold, false) AS open FROM totals t JOIN c USING (system_id)),
g AS (SELECT system_id, count(*) AS receipts, count(correct) AS usable, count(*) FILTER (open) AS unflagged, count(*) FILTER (open AND correct IS NOT NULL) AS unflagged_scored, count(*) FILTER (open AND NOT correct) AS unflagged_wrong,
  count(*) FILTER (parse_status <> 'ok' OR span_score IS NULL) AS hard_failures FROM r GROUP BY 1)
SELECT *, round({rate("unflagged_scored", "usable")}, 9) AS scored_coverage, round({rate("unflagged_wrong", "unflagged_scored")}, 9) AS selective_error, round({err_lo}, 9) AS error_low, round({err_hi}, 9) AS error_high,
  round({rate("unflagged", "receipts")}, 9) AS routing_coverage, unflagged - unflagged_scored AS unflagged_unscored, receipts - unflagged AS review_count FROM g""",
        "routes": f"""WITH {PREDICTIONS}, r AS (SELECT system_id, receipt, CASE WHEN parse_status <> 'ok' THEN 'total_' || parse_status WHEN span_score IS NULL THEN 'total_score_unavailable' WHEN span_score < 0.5 THEN 'score_below_threshold' END AS reason FROM totals)
SELECT system_id, receipt, CASE WHEN reason IS NULL THEN 'total_unflagged' ELSE 'needs_review' END AS state, reason FROM r""",
        "failure_panel": f"""WITH {PREDICTIONS}, c AS (SELECT system_id || '/' || CASE WHEN correct THEN 'success' WHEN parse_status = 'no_candidate' THEN 'failure_or_no_candidate' WHEN receipt % 9 = 0 THEN 'ocr_loss' ELSE 'extraction_error' END AS category, receipt FROM totals WHERE correct IS NOT NULL)
SELECT category, arg_min(receipt, sha256('panel|' || receipt)) AS receipt, count(*) AS n FROM c GROUP BY category""",
        "epoch_choice": """WITH y AS (SELECT l_returnflag, year(l_shipdate)::INT AS epoch, sum(l_quantity::BIGINT)::BIGINT AS score FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, epoch, score FROM y QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, epoch) = 1""",
        "token_windows": f"""WITH p AS (SELECT doc_id AS page_id, len({words("text")}) AS n FROM documents), q AS (SELECT page_id, n, unnest(range(0, greatest(1, CASE WHEN n <= 496 THEN 1 ELSE 1 + ceil((n - 496) / 368.0)::BIGINT END))) AS w FROM p)
SELECT page_id, w::INT AS "window", w * 368 AS start, least(w * 368 + 496, n)::BIGINT AS stop FROM q""",
        "span_decode": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE * 8) AS x FROM embeddings),
f AS (SELECT vec_id, i, exp(x[i]) AS ei, exp(x[i] * (i % 5 - 2)) AS ri FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM v)), t AS (SELECT vec_id, sum(ei) AS s, sum(ri) AS r FROM f GROUP BY 1),
p AS (SELECT a.vec_id, a.i, b.i AS j, round(a.ei / s * (b.ri / r), 15) AS sc, a.ei / s * (b.ri / r) AS raw FROM f a JOIN f b ON a.vec_id = b.vec_id AND b.i BETWEEN a.i AND a.i + 14 JOIN t ON t.vec_id = a.vec_id)
SELECT vec_id, (i - 1)::INT AS answer_start, (j - 1)::INT AS answer_end, round(raw, 9) AS score FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sc DESC, i, j) = 1""",
        "replay_differences": f"""WITH {RECEIPTS}, b AS (SELECT receipt, CASE WHEN receipt % 20 = 1 THEN subtotal + 1 ELSE subtotal END AS subtotal, total FROM receipts WHERE receipt % 50 <> 0),
j AS (SELECT a.receipt, a.subtotal AS s0, b.subtotal AS s1, a.total AS t0, b.total AS t1, b.receipt IS NULL AS gone FROM receipts a LEFT JOIN b USING (receipt)),
c AS (SELECT receipt, gone, 'subtotal' AS field, s0::DOUBLE AS first, s1::DOUBLE AS second FROM j UNION ALL SELECT receipt, gone, 'total', t0, t1 FROM j)
SELECT receipt, field, first, second FROM c WHERE gone OR abs(first - second) > 1e-6 + 1e-5 * abs(second)""",
        "upserted_orders": "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'corrected' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
        "wide_export": "WITH " + PREDICTIONS + " SELECT system_id, receipt, " + ", ".join(
            f"coalesce(max(raw_text) FILTER (field = '{f}'), '') AS {f}_raw_text, coalesce(max(parse_status) FILTER (field = '{f}'), '') AS {f}_parse_status, max(span_score) FILTER (field = '{f}') AS {f}_span_score" for f in ("subtotal_amount", "tax_amount", "total_amount")
        ) + " FROM predictions GROUP BY 1, 2",
        "json_lines": """SELECT event_id, CASE WHEN event_id % 10 > 1 THEN json_extract(props, '$.k')::INT END AS k, CASE WHEN event_id % 10 = 0 THEN 'REFUSED' WHEN event_id % 10 = 1 THEN 'ARRAY' ELSE 'OBJECT' END AS kind FROM events""",
        "ocr_rows": f"""WITH {LINES}, c AS (SELECT receipt, line, pos::INT AS pos, CASE WHEN line = 102 AND pos = 0 THEN '' ELSE text END AS text, x0, least(400.0, CASE WHEN pos = 3 THEN x0 ELSE x1 END) AS x1, CASE WHEN line <> 101 THEN confidence END AS confidence FROM tokens)
SELECT receipt, line, pos, text, x1, confidence, CASE WHEN text = '' THEN 'blank' WHEN x1 <= x0 THEN 'no_area' END AS reason FROM c""",
        "corpus_ids": "SELECT doc_id, format('{}-{:03d}', source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id FROM documents",
        "verified_rows": """WITH have AS (SELECT url AS path, strlen(html) AS n, sha256(html) AS sha FROM pages),
listed AS (SELECT CASE WHEN page_id % 10 = 5 THEN url || '~' ELSE url END AS path, strlen(html) + CASE WHEN page_id % 10 = 4 THEN 1 ELSE 0 END AS n, CASE WHEN page_id % 10 = 3 THEN sha256(html || ' ') ELSE sha256(html) END AS sha FROM pages),
j AS (SELECT coalesce(h.path, l.path) AS path, CASE WHEN h.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'undeclared' WHEN h.n <> l.n THEN 'size' WHEN h.sha <> l.sha THEN 'digest' END AS problem FROM have h FULL JOIN listed l ON h.path = l.path)
SELECT * FROM j WHERE problem IS NOT NULL""",
        "ocr_cohort": f"""WITH d AS (SELECT doc_id AS receipt, min(doc_id) OVER (PARTITION BY text) AS first, len({words("text")})::INT AS n FROM documents)
SELECT receipt, CASE WHEN first % 2 = 0 THEN 'ok' WHEN first % 3 = 0 THEN 'ocr_error' WHEN n = 0 THEN 'ocr_empty' ELSE 'ok' END AS status, first % 2 = 0 AS cached, CASE WHEN first % 2 = 0 OR first % 3 <> 0 THEN n ELSE 0 END AS n_tokens FROM d""",
        "annotation_violations": f"""WITH {PREDICTIONS}, a AS (SELECT receipt, field, CASE WHEN receipt % 19 = 0 THEN 'absent' WHEN receipt % 23 = 0 THEN 'maybe' ELSE 'present' END AS status, raw_text, normalized_amount FROM predictions WHERE system_id = 'noisy'),
v AS (SELECT receipt, field, CASE WHEN status = 'maybe' THEN 'unknown_status' WHEN status = 'absent' THEN CASE WHEN raw_text IS NOT NULL THEN 'absent_with_value' END WHEN raw_text IS NULL THEN 'present_without_value' WHEN receipt % 29 = 0 THEN 'contradictory' END AS violation FROM a)
SELECT * FROM v WHERE violation IS NOT NULL""",
        "expressible_amounts": f"""WITH {PREDICTIONS}, p AS (SELECT receipt % 3 AS style, contains(raw_text, '.') OR contains(raw_text, ',') AS sep FROM predictions WHERE system_id = 'exact'),
q AS (SELECT style, policy, policy = 'cord_mixed_v1' OR NOT sep OR (style = 0 AND policy = 'comma_decimal_dot_grouping') OR (style = 1 AND policy = 'dot_decimal_comma_grouping') AS kept FROM p, (VALUES ('cord_mixed_v1'), ('dot_decimal_comma_grouping'), ('comma_decimal_dot_grouping')) v(policy))
SELECT style, policy, count(*) AS n, count(*) FILTER (kept) AS kept FROM q GROUP BY 1, 2""",
        "evaluation_rows": f"""WITH {LINES}, {PREDICTIONS.partition("refs AS")[1]}{PREDICTIONS.partition("refs AS")[2]},
pages AS (SELECT receipt, list(text ORDER BY line, pos) AS page FROM tokens GROUP BY 1), {page_runs("receipt", "page", "pages")}, gold AS (SELECT receipt, field, raw_text AS gold FROM predictions WHERE system_id = 'exact'),
r AS (SELECT system_id, coalesce(raw_text, '') AS said, {norm("raw_text")} AS a, {norm("gold")} AS b, run IS NOT NULL AS shown FROM predictions JOIN gold USING (receipt, field) LEFT JOIN runs ON (runs.receipt, run) = (predictions.receipt, {norm("raw_text")})),
s AS (SELECT *, {similarity("a", "b")} AS sim FROM r)
SELECT system_id, count(*) AS n, round(avg(CASE WHEN sim >= 0.5 THEN sim ELSE 0.0 END), 9) AS anls, round(avg((a = b)::INT), 9) AS exact, round(avg((a <> '' AND shown)::INT), 9) AS shown, round(avg((said = '')::INT), 9) AS empty FROM s GROUP BY 1""",
        "prediction_digests": f"""WITH {PREDICTIONS}, j AS (SELECT system_id, receipt, '{{"fields":{{' || string_agg('"' || field || '":"' || coalesce(normalized_amount, 'none') || '|' || parse_status || '"', ',' ORDER BY field) || '}},"receipt":' || receipt || ',"system_id":"' || system_id || '"}}' AS t FROM predictions GROUP BY 1, 2)
SELECT system_id, receipt, sha256(t) AS digest, length(t)::INT AS n_chars FROM j""",
        "category_aliases": f"WITH {LINES} SELECT category, count(*) AS n FROM rlines GROUP BY 1",
        "role_counts": f"""WITH {RECEIPTS}, i AS (SELECT l_orderkey AS receipt, count(*) AS k FROM lineitem GROUP BY 1) SELECT role, count(r.receipt) AS receipts, coalesce(sum(k), 0)::BIGINT AS items FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(role) LEFT JOIN receipts r ON status = role LEFT JOIN i USING (receipt) GROUP BY role""",
        "mixed_runs": "SELECT o_custkey, count(DISTINCT o_orderstatus || '|' || o_orderpriority) AS identities FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus || '|' || o_orderpriority) > 1",
        "shared_words": f"""WITH {turns}, p AS (SELECT conv_id, turn, {words(norm("text"))} AS a, {words(norm("next_text"))} AS b FROM turns WHERE next_text IS NOT NULL)
SELECT conv_id, turn, len(list_intersect(a, b)) > 0 AS shared, len(list_distinct(list_intersect(a, b)))::INT AS n_shared, a[-1] AS last FROM p""",
        "quoted_digests": """SELECT DISTINCT doc_id, d[2:41] AS digest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^0-9a-f]([0-9a-f]{40})[^0-9a-f]')) AS d FROM (SELECT doc_id, ' ' || text || ' ' AS text FROM documents))""",
    }
    policies = {"cord_mixed_v1": (".,", ".,"), "dot_decimal_comma_grouping": (",", "."), "comma_decimal_dot_grouping": (".", ",")}
    return out | {f"amounts_{k}": amounts(*v) for k, v in policies.items()}


ORACLES = oracles()
