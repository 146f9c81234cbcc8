"""The same queries in SQL for DuckDB, over views named as the tables: name -> statement.

Left out, because SQL does not say the same: approximate methods.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# Pieces shared by several statements.

_LINES = """
per_line AS (
  SELECT o_orderkey, l_linenumber, count(l_orderkey) AS n,
         sum(CASE WHEN l_shipdate < o_orderdate THEN 1 ELSE 0 END) AS early,
         count(DISTINCT l_partkey) AS parts
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY ALL),
per_case AS (
  SELECT o_orderkey,
         CASE WHEN sum(n) > 0 THEN sum(early) / sum(n) END AS date_order,
         CASE WHEN sum(n) > 0 THEN avg(CASE WHEN parts > 1 THEN 1.0 ELSE 0.0 END) END AS conflict
  FROM per_line GROUP BY ALL),
signals AS (
  SELECT o_orderkey AS case_id, 0.3 AS w, date_order AS v FROM per_case
  UNION ALL SELECT o_orderkey, 0.3, conflict FROM per_case
  UNION ALL SELECT o_orderkey, 0.4, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END
            FROM orders JOIN customer ON c_custkey = o_custkey),
sums AS (
  SELECT case_id, sum(CAST(w * 1000000 AS BIGINT) * CAST(floor(CAST(v AS DOUBLE) * 1e9 + 0.5) AS BIGINT)) AS wv,
         sum(CAST(w * 1000000 AS BIGINT)) AS w
  FROM signals WHERE v IS NOT NULL GROUP BY ALL),
scored AS (SELECT case_id, (2 * wv + 1000 * w) // (2000 * w) / 1000000 AS score FROM sums),
decided AS (
  SELECT *, CASE WHEN score < 0.4 THEN 'clear' WHEN score < 0.7 THEN 'review' ELSE 'refer' END AS decision
  FROM scored)
"""

SQL["screen"] = f"""
WITH {_LINES}
SELECT r_name, n_name, decision, CAST(grouping(r_name, n_name, decision) AS BIGINT) AS level, count(*) AS cases
FROM decided JOIN orders ON o_orderkey = case_id JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name, decision)
"""

SQL["case_decisions"] = f"WITH {_LINES} SELECT case_id, score, decision FROM decided"

SQL["unpivot_fields"] = """
SELECT p_partkey, field, value FROM (
  SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
         CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part)
UNPIVOT INCLUDE NULLS (value FOR field IN (p_name, p_brand, p_type, p_size, p_retailprice))
"""

# The marked capitals and what they fold to, as in the library.
_FOLD = "'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ', 'AAAAAACEEEEIIIINOOOOOOUUUUY'"


def _clean(value: str) -> str:
    one_line = f"trim(regexp_replace({value}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
    # Upper-casing sharp s gives SS in one engine and leaves it in the other.
    return f"nullif(translate(upper(replace({one_line}, 'ß', 'SS')), {_FOLD}), '')"


SQL["normalize_fields"] = f"""
SELECT doc_id, field, {_clean('value')} AS value FROM (SELECT doc_id, text, lang, source FROM documents)
UNPIVOT INCLUDE NULLS (value FOR field IN (text, lang, source))
"""

SQL["normalize_dates"] = f"""
WITH long AS (
  SELECT o_orderkey, 'day_first' AS field, strftime(o_orderdate, '%d/%m/%Y') AS value FROM orders
  UNION ALL SELECT o_orderkey, 'iso', strftime(o_orderdate, ' %Y-%m-%d ') FROM orders
  UNION ALL SELECT o_orderkey, 'impossible', strftime(o_orderdate, '%Y-%m-31') FROM orders
  UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders)
SELECT o_orderkey, field,
       CASE WHEN field = 'o_orderpriority' THEN {_clean('value')}
            ELSE CAST(CAST(coalesce(try_strptime(trim(value), '%Y-%m-%d'), try_strptime(trim(value), '%d/%m/%Y'))
                 AS DATE) AS VARCHAR) END AS value
FROM long
"""

SQL["validate_format"] = """
WITH long AS (
  SELECT p_partkey, p_type AS doc_type, 'p_name' AS field, p_name AS value FROM part
  UNION ALL SELECT p_partkey, p_type, 'p_brand', p_brand FROM part
  UNION ALL SELECT p_partkey, p_type, 'p_size', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, p_type, 'p_note', NULL FROM part),
rules(doc_type, field, pattern, required) AS (VALUES
  ('ECONOMY', 'p_name', '^[a-z]+ [a-z]+$', true), ('ECONOMY', 'p_brand', '^Brand#[0-9]$', true),
  ('SMALL', 'p_size', '^[1-9]$', true), ('SMALL', 'p_brand', '^Brand#1[0-9]$', true),
  ('LARGE', 'p_size', '^[2-5][0-9]$', true), ('PROMO', 'p_name', '(red|blue) ', false),
  ('PROMO', 'p_note', 'x', true), ('MEDIUM', 'p_note', 'x', false))
SELECT p_partkey, doc_type, field, value,
       CASE WHEN value IS NULL AND required THEN 'missing' WHEN value IS NULL THEN 'pass'
            WHEN regexp_matches(value, pattern) THEN 'pass' ELSE 'fail' END AS status
FROM long JOIN rules USING (doc_type, field)
"""

_CARDS = """
cards AS (
  SELECT doc_id, number FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM documents)
  WHERE length(number) >= 2)
"""

SQL["validate_check_digit"] = f"""
WITH {_CARDS}
SELECT doc_id, number,
       list_sum(list_transform(range(1, length(number)), lambda i: CAST(number[i] AS BIGINT) * ([7, 3, 1])[((i - 1) % 3) + 1])) % 10
       = CAST(number[-1] AS BIGINT) AS check_ok
FROM cards
"""

SQL["validate_luhn"] = f"""
WITH {_CARDS}
SELECT doc_id, number,
       list_sum(list_transform(range(1, length(number) + 1), lambda i:
         CASE WHEN (length(number) - i) % 2 = 0 THEN CAST(number[i] AS BIGINT)
              WHEN CAST(number[i] AS BIGINT) > 4 THEN CAST(number[i] AS BIGINT) * 2 - 9
              ELSE CAST(number[i] AS BIGINT) * 2 END)) % 10 = 0 AS check_ok
FROM cards
"""

SQL["validate_order"] = """
SELECT o_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
"""

SQL["field_conflicts"] = """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS readings FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n_values FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, readings, n_values
FROM v JOIN n USING (l_orderkey, l_linenumber) WHERE n_values > 1
"""

SQL["fuzzy_matches"] = """
WITH v AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL)
SELECT a.p_brand, a.p_name AS left_value, b.p_name AS right_value, a.n AS left_rows, b.n AS right_rows,
       CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS distance
FROM v a JOIN v b ON a.p_brand = b.p_brand AND a.p_name < b.p_name
WHERE levenshtein(a.p_name, b.p_name) <= 3
"""

SQL["fuzzy_registry_names"] = """
WITH a AS (SELECT c_nationkey AS nation, replace(c_name, 'Customer', 'Person') AS name, count(*) AS n
           FROM customer GROUP BY ALL),
b AS (SELECT s_nationkey AS nation, replace(s_name, 'Supplier', 'Person') AS name, count(*) AS n
      FROM supplier GROUP BY ALL)
SELECT nation, a.name AS left_value, b.name AS right_value, a.n AS left_rows, b.n AS right_rows,
       CAST(levenshtein(a.name, b.name) AS BIGINT) AS distance
FROM a JOIN b USING (nation) WHERE levenshtein(a.name, b.name) <= 1
"""

SQL["registry_check"] = """
WITH c AS (
  SELECT o_orderkey, claim AS c_custkey, k.c_custkey IS NOT NULL AS found,
         CASE WHEN k.c_nationkey IS DISTINCT FROM o_custkey % 25 THEN 'c_nationkey' END AS d1,
         CASE WHEN k.c_mktsegment IS DISTINCT FROM 'MACHINERY' THEN 'c_mktsegment' END AS d2
  FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN -o_custkey ELSE o_custkey END AS claim FROM orders)
  LEFT JOIN customer k ON k.c_custkey = claim)
SELECT o_orderkey, c_custkey,
       CASE WHEN NOT found THEN 'not_found' WHEN d1 IS NULL AND d2 IS NULL THEN 'found' ELSE 'mismatch' END AS status,
       CASE WHEN found THEN concat_ws(',', d1, d2) ELSE '' END AS differing
FROM c
"""

SQL["not_in_registry"] = """
SELECT o_orderkey, claim AS c_custkey
FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN -o_custkey ELSE o_custkey END AS claim FROM orders)
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = claim)
"""

SQL["listed"] = """
SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
"""

_AS_OF = """
r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id AS view_id, user_id, ts AS view_ts, value AS view_value, ts + INTERVAL 2 DAY AS ends
      FROM events WHERE event_type = 'view'),
found AS (SELECT r.*, v.view_ts AS version_from, v.view_id, v.view_value, v.ends
          FROM r ASOF LEFT JOIN v ON r.user_id = v.user_id AND r.ts >= v.view_ts)
"""

SQL["registry_as_of"] = f"WITH {_AS_OF} SELECT event_id, user_id, ts, version_from, view_id, view_value FROM found"

SQL["registry_valid_at"] = f"""
WITH {_AS_OF}
SELECT event_id, user_id, ts, CASE WHEN ends > ts THEN version_from END AS version_from,
       CASE WHEN ends > ts THEN view_id END AS view_id, CASE WHEN ends > ts THEN view_value END AS view_value
FROM found
"""

_SIDES = """
a AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment,
             floor(c_acctbal / 100)::BIGINT AS balance FROM customer),
b AS (SELECT id, CASE WHEN id % 11 > 0 THEN name END AS name, CASE WHEN id % 5 = 0 THEN (nation + 1) % 25 ELSE nation END AS nation,
             CASE WHEN id % 7 = 0 THEN 'OTHER' ELSE segment END AS segment,
             CASE WHEN id % 13 = 0 THEN balance + 1 ELSE balance END AS balance FROM a),
pairs AS (SELECT a.id AS left_id, b.id AS right_id,
                 (coalesce(a.name = b.name, false)::INT + 2 * (a.nation = b.nation)::INT + 4 * (a.segment = b.segment)::INT
                  + 8 * (a.balance = b.balance)::INT)::BIGINT AS pattern FROM a, b)
"""

SQL["agreement_patterns"] = f"""
WITH {_SIDES}
SELECT p AS pattern, coalesce(n, 0) AS pairs FROM range(16) AS every(p)
LEFT JOIN (SELECT pattern, count(*) AS n FROM pairs GROUP BY 1) ON p = pattern
"""

SQL["exact_reuse"] = """
SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n_rows, count(DISTINCT source) AS n_identities
FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1
"""

_NEAR = """
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS ws
      FROM documents),
f AS (SELECT ws, min(doc_id) AS id FROM w WHERE len(ws) >= 1 GROUP BY ws),
s AS (SELECT id, CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1),
             lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS st FROM f),
e AS (SELECT id, len(st) AS n, unnest(st) AS tok FROM s),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS k
      FROM e a JOIN e b ON a.tok = b.tok AND a.id < b.id GROUP BY ALL),
near AS (
  SELECT id_a, id_b, round(k / (na + nb - k), 6) AS jaccard FROM p WHERE k / (na + nb - k) >= 0.5
  UNION ALL SELECT f.id, w.doc_id, 1.0 FROM w JOIN f ON f.ws = w.ws WHERE w.doc_id <> f.id)
"""

SQL["near_reuse"] = f"WITH {_NEAR} SELECT id_a, id_b, CAST(jaccard AS DOUBLE) AS jaccard FROM near"

SQL["altered_lines"] = f"""
WITH {_NEAR},
l AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS lines FROM documents),
t AS (SELECT id_a, id_b, a.lines AS la, b.lines AS lb
      FROM near JOIN l a ON a.doc_id = id_a JOIN l b ON b.doc_id = id_b)
SELECT id_a, id_b, 'a' AS side, line FROM
  (SELECT id_a, id_b, unnest(list_filter(la, lambda x: NOT list_contains(lb, x))) AS line FROM t)
UNION ALL
SELECT id_a, id_b, 'b', line FROM
  (SELECT id_a, id_b, unnest(list_filter(lb, lambda x: NOT list_contains(la, x))) AS line FROM t)
"""

SQL["template_outliers"] = """
WITH m AS (SELECT source, quantile_cont(n_chars, 0.5) AS median FROM documents GROUP BY 1),
d AS (SELECT source, median, quantile_cont(abs(n_chars - median), 0.5) AS mad
      FROM documents JOIN m USING (source) GROUP BY ALL)
SELECT doc_id, source, n_chars, median, mad FROM documents JOIN d USING (source)
WHERE mad > 0 AND abs(n_chars - median) > 3 * 1.4826 * mad
"""

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

SQL["match_one_to_one"] = f"""
SELECT a.vec_id AS case_id, round({_COS}, 6) AS cosine, coalesce({_COS} >= 0.1, false) AS is_match,
       CASE WHEN b.vec_id IS NULL THEN 'no_photo' ELSE 'compared' END AS status
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id - 1 = a.vec_id
"""

_TOP = f"""
c AS (SELECT a.vec_id AS probe_id, b.vec_id AS gallery_id, round({_COS}, 6) AS cosine
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY cosine DESC, gallery_id) AS place FROM c
        QUALIFY place <= 5)
"""

SQL["match_one_to_many"] = f"WITH {_TOP} SELECT probe_id, gallery_id, cosine, place FROM top"

SQL["match_one_to_many_indexed"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT vec_id, list_transform(e, lambda x, i: x + e[1 + i % len(e)] / 4) AS e FROM v),
c AS (SELECT p.vec_id AS probe_id, v.vec_id AS gallery_id, round(list_cosine_similarity(p.e, v.e), 6) AS cosine FROM p, v)
SELECT probe_id, gallery_id, cosine, place
FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY cosine DESC, gallery_id) AS place FROM c)
WHERE place = 1
"""

SQL["near_vectors"] = f"""
SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_COS}, 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.3
"""

SQL["shared_face_groups"] = f"""
WITH RECURSIVE e AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_COS} >= 0.4),
r(id, seen) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.seen),
g AS (SELECT id, min(seen) AS group_id FROM r GROUP BY 1),
m AS (SELECT group_id, id, label AS identity FROM g JOIN embeddings ON vec_id = id)
SELECT group_id, id, identity FROM m
WHERE group_id IN (SELECT group_id FROM m GROUP BY 1 HAVING count(DISTINCT identity) > 1)
"""

SQL["match_error_rates"] = f"""
WITH c AS (SELECT coalesce(a.label = b.label, true) AS same, round({_COS}, 6) AS cosine
           FROM embeddings a LEFT JOIN embeddings b ON b.vec_id - 1 = a.vec_id),
t(threshold) AS (VALUES (-0.1::DOUBLE), (0.0), (0.1), (0.25)),
n AS (SELECT threshold, count(*) FILTER (same) AS genuine, count(*) FILTER (NOT same) AS other,
             count(*) FILTER (NOT same AND cosine >= threshold) AS false_matches,
             count(*) FILTER (same AND (cosine IS NULL OR cosine < threshold)) AS false_non_matches
      FROM c, t GROUP BY 1)
SELECT threshold, false_matches, false_non_matches,
       round(false_matches / nullif(other, 0), 6) AS false_match_rate,
       round(false_non_matches / nullif(genuine, 0), 6) AS false_non_match_rate
FROM n
"""

_SIGNALS = """
raw AS (
  SELECT user_id AS case_id, event_type AS signal, value / 100 AS value, ts AS "at", event_id FROM events
  UNION ALL
  SELECT user_id, event_type || '_k', CAST(json_extract_string(props, '$.k') AS INTEGER) / 100, ts, event_id FROM events),
signals AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY case_id, signal ORDER BY "at" DESC, event_id DESC) = 1),
weights(signal, weight) AS (VALUES
  ('view', 0.2), ('click', 0.1), ('error', 0.3), ('error_k', 0.2), ('purchase_k', 0.4), ('absent', 0.1))
"""

# Weights in millionths and values in thousand-millionths, so that sums and the rounding of quotients are exact.
_HELD = """
held AS (SELECT case_id, signal, CAST(weight * 1000000 AS BIGINT) AS w,
                CAST(floor(greatest(0.0, least(1.0, value)) * 1e9 + 0.5) AS BIGINT) AS v, value
         FROM signals LEFT JOIN weights USING (signal))
"""

_SCORED = f"""
{_SIGNALS},
{_HELD},
sums AS (SELECT case_id, sum(w * v) AS wv, sum(w) AS w FROM held WHERE value IS NOT NULL GROUP BY 1),
skip AS (SELECT c_custkey AS case_id, (2 * wv + 1000 * w) // (2000 * w) / 1000000 AS score
         FROM customer LEFT JOIN sums ON case_id = c_custkey)
"""

SQL["collect_signals"] = f'WITH {_SIGNALS} SELECT case_id, signal, value, "at", event_id FROM signals'

SQL["signal_matrix"] = """
SELECT user_id AS case_id,
       max(value) FILTER (event_type = 'view') AS "view", max(value) FILTER (event_type = 'click') AS click,
       max(value) FILTER (event_type = 'error') AS error, max(value) FILTER (event_type = 'purchase') AS purchase,
       max(value) FILTER (event_type = 'signup') AS signup
FROM events GROUP BY 1
"""

SQL["risk_score_skip"] = f"WITH {_SCORED} SELECT case_id, score FROM skip"
SQL["risk_score_zero"] = f"WITH {_SCORED} SELECT case_id, (2 * wv + 1300000000) // 2600000000 / 1000000 AS score FROM sums"
SQL["risk_score_worst"] = f"WITH {_SCORED} SELECT case_id, (2 * (wv + (1300000 - w) * 1000000000) + 1300000000) // 2600000000 / 1000000 AS score FROM sums"

SQL["risk_decision"] = f"""
WITH {_SCORED}
SELECT case_id, score, CASE WHEN score IS NULL THEN 'review' WHEN score < 0.3 THEN 'clear'
                            WHEN score < 0.6 THEN 'review' ELSE 'refer' END AS decision
FROM skip
"""

SQL["top_reasons"] = f"""
WITH {_SIGNALS},
{_HELD},
c AS (SELECT case_id, signal, (w * v + 500000000) // 1000000000 / 1000000 AS contribution
      FROM held WHERE w IS NOT NULL AND value IS NOT NULL)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY contribution DESC, signal) AS place, signal, contribution
FROM c QUALIFY place <= 3
"""

SQL["review_queue"] = """
WITH s AS (SELECT c_nationkey, c_custkey AS case_id, round(c_acctbal / 1000, 0) AS score FROM customer)
SELECT c_nationkey, case_id, score,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, case_id) AS place,
       rank() OVER (PARTITION BY c_nationkey ORDER BY score DESC) AS score_rank,
       dense_rank() OVER (PARTITION BY c_nationkey ORDER BY score DESC) AS score_dense_rank
FROM s QUALIFY place <= 10
"""

SQL["first_in_queue"] = """
SELECT c_custkey AS case_id, c_acctbal AS score FROM customer ORDER BY score DESC, case_id LIMIT 50
"""

_LABELLED = """
s AS (SELECT doc_id, round(least(n_chars / 10000, 1.0), 3) AS score, quality AS label
      FROM documents JOIN labels USING (doc_id))
"""

SQL["calibration"] = f"""
WITH {_LABELLED},
b AS (SELECT *, (rank() OVER (ORDER BY score) - 1) * 10 // count(*) OVER () + 1 AS bin FROM s)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS cases, round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean_score,
       round(sum(label) / count(*), 6) AS observed_rate
FROM b GROUP BY 1
"""

SQL["calibration_width"] = f"""
WITH {_LABELLED}
SELECT CAST(least(floor(score * 5) + 1, 5) AS BIGINT) AS bin, count(*) AS cases,
       round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean_score,
       round(sum(label) / count(*), 6) AS observed_rate
FROM s GROUP BY 1
"""

SQL["detection_quality"] = f"""
WITH {_LABELLED},
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mean_rank FROM s),
a AS (SELECT sum(label) AS p, count(*) - sum(label) AS n, sum(mean_rank) FILTER (label = 1) AS ranks FROM r),
t(threshold) AS (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2), (0.5), (1.1)),
c AS (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
             count(*) FILTER (label = 0 AND score >= threshold) AS fp,
             count(*) FILTER (label = 0 AND score < threshold) AS tn,
             count(*) FILTER (label = 1 AND score < threshold) AS fn
      FROM s, t GROUP BY 1)
SELECT threshold, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
       round((ranks - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auc
FROM c, a
"""

_PLACES = """
places AS (SELECT r_name, n_name, c_mktsegment, c_acctbal < 0 AS owing
           FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""
_RATES = """count(*) AS cases, CAST(count(*) FILTER (owing) AS BIGINT) AS flagged,
       round(count(*) FILTER (owing) / count(*), 6) AS flagged_rate"""

SQL["checkpoint_rollup"] = f"""
WITH {_PLACES}
SELECT r_name, n_name, c_mktsegment, CAST(grouping(r_name, n_name, c_mktsegment) AS BIGINT) AS level, {_RATES}
FROM places GROUP BY ROLLUP (r_name, n_name, c_mktsegment)
"""

SQL["checkpoint_cube"] = f"""
WITH {_PLACES}
SELECT r_name, c_mktsegment, CAST(grouping(r_name, c_mktsegment) AS BIGINT) AS level, {_RATES}
FROM places GROUP BY CUBE (r_name, c_mktsegment)
"""

SQL["checkpoint_sets"] = f"""
WITH {_PLACES}
SELECT r_name, n_name, c_mktsegment, CAST(grouping(r_name, n_name, c_mktsegment) AS BIGINT) AS level, count(*) AS cases
FROM places GROUP BY GROUPING SETS ((r_name, n_name), (c_mktsegment))
"""

SQL["checkpoint_deviation"] = """
WITH p AS (SELECT c_nationkey, count(*) AS cases, count(*) FILTER (o_orderstatus = 'F') AS flagged
           FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
o AS (SELECT sum(flagged) / sum(cases) AS overall FROM p)
SELECT c_nationkey, cases, flagged, round(flagged / cases, 6) AS rate, round(overall, 6) AS overall_rate,
       round((flagged / cases - overall) / nullif(sqrt(overall * (1 - overall) / cases), 0), 6) AS z
FROM p, o
"""

SQL["stage_times"] = """
WITH s AS (
  SELECT lag(event_type) OVER w AS from_stage, event_type AS to_stage,
         (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000 AS seconds
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT from_stage, to_stage, count(*) AS steps, round(quantile_cont(seconds, 0.5), 6) AS p50_seconds,
       round(quantile_cont(seconds, 0.95), 6) AS p95_seconds, round(max(seconds), 6) AS max_seconds
FROM s WHERE seconds IS NOT NULL GROUP BY ALL
"""

SQL["stored_quantiles"] = """
SELECT event_type, share, count(value) AS n, true AS within_bound
FROM events, (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) AS asked(share) GROUP BY ALL
"""

SQL["stored_persons"] = """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS persons, true AS within_bound FROM orders GROUP BY 1
"""

SQL["volume_trend"] = """
WITH c AS (SELECT date_trunc('day', ts) AS period, count(*) AS events FROM events GROUP BY 1)
SELECT CAST(period AS TIMESTAMP) AS period, events, CAST(sum(events) OVER (ORDER BY period) AS BIGINT) AS running_total,
       round(avg(events) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_mean
FROM c
"""

SQL["volume_trend_by_type"] = """
WITH c AS (SELECT event_type, date_trunc('hour', ts) AS period, count(*) AS events FROM events GROUP BY ALL)
SELECT event_type, CAST(period AS TIMESTAMP) AS period, events,
       CAST(sum(events) OVER (PARTITION BY event_type ORDER BY period) AS BIGINT) AS running_total,
       round(avg(events) OVER (PARTITION BY event_type ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6)
         AS moving_mean
FROM c
"""

SQL["case_timeline"] = """
SELECT user_id, ts, event_id, event_type, row_number() OVER w AS place, lag(event_type) OVER w AS previous_state,
       lead(event_type) OVER w AS next_state, first_value(event_type) OVER w AS first_state,
       last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_state,
       round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000, 6) AS elapsed_seconds
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""

SQL["conversation_timeline"] = """
SELECT conv_id, turn, role, row_number() OVER w AS place, lag(role) OVER w AS previous_state,
       lead(role) OVER w AS next_state, first_value(role) OVER w AS first_state,
       last_value(role) OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_state,
       CAST(turn - lag(turn) OVER w AS DOUBLE) AS elapsed_seconds
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""

_SESSIONS = """
g AS (SELECT user_id, ts, event_id,
             CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g),
sessions AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events
             FROM n GROUP BY user_id, no)
"""

SQL["sessions"] = f"WITH {_SESSIONS} SELECT user_id, session_start, session_end, events FROM sessions"


def _row_text(text: str) -> str:
    parts = ["CAST(conv_id AS VARCHAR)", "CAST(turn AS VARCHAR)", "role", text]
    return " || ".join(f"coalesce(CAST(strlen({p}) AS VARCHAR) || ':' || {p}, '-:')" for p in parts)


_CHAIN = "list_reduce(list_prepend('', list(t ORDER BY p)), lambda a, x: sha256(a || x))"


def _digests(name: str, source: str) -> str:
    """CTEs ending in `name` (conv_id, digest, rows), over `source` (conv_id, turn, role, text)."""
    levels = [
        f"{name}_1 AS (SELECT conv_id, turn // 3 AS g, {_CHAIN} AS t, count(*) AS n FROM"
        f" (SELECT conv_id, turn, turn AS p, sha256({_row_text('text')}) AS t FROM {source}) GROUP BY ALL)"
    ]
    for i in (2, 3):
        levels.append(
            f"{name}_{i} AS (SELECT conv_id, p // 3 AS g, {_CHAIN} AS t, sum(n) AS n FROM"
            f" (SELECT conv_id, g AS p, t, n FROM {name}_{i - 1}) GROUP BY ALL)"
        )
    levels.append(
        f"{name} AS (SELECT conv_id, {_CHAIN} AS digest, CAST(sum(n) AS BIGINT) AS rows FROM"
        f" (SELECT conv_id, g AS p, t, n FROM {name}_3) GROUP BY ALL)"
    )
    return ",\n".join(levels)


SQL["trail_segments"] = f"""
WITH {_digests('d', 'conversations')}
SELECT conv_id, g AS segment_no, t AS digest, n AS rows FROM d_1
"""

SQL["trail_digest"] = f"WITH {_digests('d', 'conversations')} SELECT conv_id, digest, rows FROM d"

_EDITED = """
edited AS (SELECT conv_id, turn, role, replace(text, 'tion', 'sion') AS text FROM conversations
           WHERE NOT (role = 'assistant' AND length(text) < 60))
"""

SQL["trail_verify"] = f"""
WITH {_EDITED.replace('length(text) < 60', "length(replace(text, 'tion', 'sion')) < 60")},
now_rows AS (SELECT CASE WHEN conv_id % 11 = 0 THEN -1 - conv_id ELSE conv_id END AS conv_id, turn, role, text FROM edited),
{_digests('was', 'conversations')},
{_digests('now', 'now_rows')}
SELECT coalesce(was.conv_id, now.conv_id) AS conv_id,
       CASE WHEN now.digest IS NULL THEN 'missing' WHEN was.digest IS NULL THEN 'extra'
            WHEN now.digest = was.digest AND now.rows = was.rows THEN 'same' ELSE 'changed' END AS status,
       was.rows AS rows_then, now.rows AS rows_now
FROM was FULL JOIN now ON was.conv_id = now.conv_id
"""

SQL["trail_diff"] = f"""
WITH {_EDITED},
added AS (SELECT conv_id, turn, role, text FROM edited EXCEPT ALL SELECT conv_id, turn, role, text FROM conversations),
removed AS (SELECT conv_id, turn, role, text FROM conversations EXCEPT ALL SELECT conv_id, turn, role, text FROM edited)
SELECT *, 'added' AS change, count(*) AS n FROM added GROUP BY ALL
UNION ALL SELECT *, 'removed', count(*) FROM removed GROUP BY ALL
"""

SQL["trail_changes"] = f"""
WITH {_EDITED}
SELECT coalesce(c.conv_id, e.conv_id) AS conv_id, coalesce(c.turn, e.turn) AS turn,
       CASE WHEN e.conv_id IS NULL THEN 'missing' WHEN c.conv_id IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM conversations c FULL JOIN edited e ON c.conv_id = e.conv_id AND c.turn = e.turn
WHERE c.conv_id IS NULL OR e.conv_id IS NULL OR c.text IS DISTINCT FROM e.text
"""

SQL["trail_proofs"] = f"""
WITH {_EDITED}
SELECT e.conv_id, e.turn AS leaf, c.text IS NOT DISTINCT FROM e.text AS holds
FROM edited e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn = e.turn
"""

SQL["trail_append_and_read"] = """
SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS event_date,
       CASE WHEN event_type = 'error' THEN 'second' ELSE 'first' END AS batch_id
FROM events
"""

# A stream gives out what has closed: whatever ends no later than the newest event less the delay of an hour.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"

SQL["live_window_counts"] = f"""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type, count(*) AS events
FROM events GROUP BY 1, 2, 3 HAVING window_end <= {_CLOSED}
"""

SQL["live_sliding_counts"] = f"""
WITH s AS (SELECT unnest([0, 1, 2]) AS back, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS slot FROM events)
SELECT slot - to_hours(2 * back) AS window_start, slot - to_hours(2 * back) + INTERVAL 6 HOUR AS window_end, count(*) AS events
FROM s GROUP BY 1, 2 HAVING window_end <= {_CLOSED}
"""

SQL["live_sessions"] = f"""
WITH {_SESSIONS}
SELECT user_id, session_start, session_end, events FROM sessions
WHERE session_end + INTERVAL 30 MINUTE <= {_CLOSED}
"""

SQL["live_drop_repeats"] = "SELECT DISTINCT user_id, event_type FROM events"

SQL["live_registry_check"] = """
SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'not_found' WHEN c_nationkey = user_id % 25 THEN 'found'
                      ELSE 'mismatch' END AS status,
       CASE WHEN c_custkey IS NOT NULL AND c_nationkey IS DISTINCT FROM user_id % 25 THEN 'c_nationkey' ELSE '' END AS differing
FROM events LEFT JOIN customer ON c_custkey = CASE WHEN event_id % 10 = 0 THEN -user_id ELSE user_id END
"""

SQL["live_registry_as_of"] = f"""
WITH {_AS_OF},
closed AS (SELECT date_trunc('millisecond', least((SELECT max(ts) FROM r), (SELECT max(view_ts) FROM v))) - INTERVAL 1 HOUR AS until)
SELECT event_id, user_id, ts, version_from, view_id, view_value FROM found, closed WHERE ts <= until
"""

SQL["live_join_within"] = """
SELECT a.user_id, a.event_id AS view_id, a.ts AS view_ts, b.event_id AS purchase_id, b.ts AS purchase_ts
FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR
WHERE a.event_type = 'view' AND b.event_type = 'purchase'
"""

SQL["live_complete_cases"] = f"""
WITH f AS (SELECT user_id, event_type, min(ts) AS seen FROM events GROUP BY ALL),
s AS (SELECT user_id, min(seen) AS first_at FROM f GROUP BY 1),
t AS (SELECT user_id, first_at, max(seen) AS last_at, list(event_type) AS there
      FROM f JOIN s USING (user_id) WHERE seen <= first_at + INTERVAL 2 DAY GROUP BY ALL),
m AS (SELECT *, list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(there, x)) AS gone
      FROM t)
SELECT CAST(user_id AS VARCHAR) AS case_id, CASE WHEN len(gone) = 0 THEN 'complete' ELSE 'timed_out' END AS status,
       first_at, last_at, array_to_string(gone, ',') AS missing
FROM m WHERE len(gone) = 0 OR first_at + INTERVAL 2 DAY < {_CLOSED}
"""
