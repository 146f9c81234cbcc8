"""The queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

_NORMALISED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH rows AS (SELECT doc_id, sha256({_NORMALISED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM rows WINDOW same AS (PARTITION BY text_sha256)
"""

OP6 = r"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
           ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
    SELECT p.page_id, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
           arg_max(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
    FROM parts p JOIN rules r
      ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
    GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE
           WHEN regexp_full_match(p.host || p.path, '[^/]*spam[^/]*/.*', 's')
             OR contains(p.host || p.path, '/wp-login') OR contains(p.host || p.path, '/cart/')
             OR regexp_full_match(p.host || p.path, '.*\....\.html', 's') THEN 'block'
           ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""

_WORDS = r"""list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP13 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
cut AS (
    SELECT item_id, unnest(CASE WHEN len(w) >= 10 THEN [w[i:i + 9] for i in range(1, len(w) - 8)]
                                WHEN len(w) > 0 THEN [w] ELSE [] END) AS win
    FROM items
), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
    SELECT doc_id, n, i, w[i:i + n - 1] AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM docs, (SELECT DISTINCT len(win)::BIGINT AS n FROM cut) sizes)
), hits AS (SELECT doc_id, n, i, item_id FROM places JOIN (SELECT DISTINCT * FROM cut) USING (win)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
          FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# One state per column, each the cheapest (cost, audit) that leads there; least() takes the audit that comes first.
_KEEP = "CASE WHEN NOT forced AND initial = '{i}' THEN {{'c': {s}.c + extra, 'a': {s}.a || 'K'}} ELSE far END"
_REROLE = "CASE WHEN NOT forced THEN {{'c': {s}.c + 3 + extra, 'a': {s}.a || 'R'}} ELSE far END"
_DELETE = "{{'c': {s}.c + 4, 'a': {s}.a || 'D'}}"
_INSERT = "{{'c': {s}.c + 3, 'a': {s}.a || 'I'}}"


def _into_user(frm: str) -> str:
    return f"{_KEEP.format(i='u', s=frm)}, {_REROLE.format(s=frm)}"


OP11 = rf"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_prepend(n, range(8)), lambda x, y:
               CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS tab
    FROM range(256) AS t(n)
), damage AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
               lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc
), rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM damage
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM rows
), faulty AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS previous
    FROM placed
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), steps AS (
    SELECT conv_id, k, initial, fault IN ('blank', 'duplicate') AS forced,
           CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra, {{'c': 1000000000, 'a': ''}} AS far
    FROM faulty
), dp AS (
    SELECT conv_id, 0::BIGINT AS k, {{'c': 0, 'a': ''}} AS s0, {{'c': 1000000000, 'a': ''}} AS s1,
           {{'c': 3, 'a': 'I'}} AS s2, {{'c': 6, 'a': 'II'}} AS s3
    FROM counts
    UNION ALL
    SELECT conv_id, k, s0, s1, least(s2, {_INSERT.format(s='s0')}, {_INSERT.format(s='s1')}, {_INSERT.format(s='s3')}),
           least(s3, {_INSERT.format(s='s2')}, {{'c': least(s0, s1).c + 6, 'a': least(s0, s1).a || 'II'}})
    FROM (
        SELECT conv_id, steps.k, far, {_DELETE.format(s='s0')} AS s0,
               least({_DELETE.format(s='s1')}, {_KEEP.format(i='s', s='s0')}) AS s1,
               least({_DELETE.format(s='s2')}, {_into_user('s0')}, {_into_user('s1')}, {_into_user('s3')}) AS s2,
               least({_DELETE.format(s='s3')}, {_KEEP.format(i='a', s='s2')}, {_REROLE.format(s='s2')}) AS s3
        FROM dp JOIN steps USING (conv_id) WHERE steps.k = dp.k + 1
    )
), best AS (
    SELECT conv_id, least(s0, s3).c AS cost, least(s0, s3).a AS audit FROM dp JOIN counts USING (conv_id) WHERE k = n
), letters AS (
    SELECT conv_id, j, audit[j] AS e, length(replace(audit, 'D', '')) % 2 AS odd,
           length(replace(left(audit, j), 'I', '')) AS k, length(replace(left(audit, j), 'D', '')) AS place
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)
), lines AS (
    SELECT l.conv_id, j, CASE WHEN e = 'K' THEN role WHEN (place + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
               || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
    FROM letters l LEFT JOIN placed p ON p.conv_id = l.conv_id AND p.k = l.k WHERE e <> 'D'
), texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS repaired FROM lines GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations)
LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN texts USING (conv_id)
"""

OP12 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, range(1, 5) AS sizes(size))
), f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a, lang || chr(10) || phrase AS key FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
found AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE size >= 2 AND a >= 30),
cuts AS MATERIALIZED (
    SELECT lang, phrase, a, k, lang || chr(10) || array_to_string(w[1:k], ' ') AS head,
           lang || chr(10) || array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM found)
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
    FROM cuts c JOIN f x ON x.key = c.head JOIN f y ON y.key = c.tail
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a AS longer
    FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM found))
), alone AS (
    SELECT * FROM lowest q WHERE NOT EXISTS (
        SELECT 1 FROM inner_ i WHERE i.lang = q.lang AND i.phrase = q.phrase AND 100 * i.longer >= 80 * q.a)
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
JOIN n USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op4_exact_dedup": OP4,
    "op6_url_filter": OP6,
    "op11_conversation_repair": OP11,
    "op12_collocations": OP12,
    "op13_decontamination": OP13,
}
