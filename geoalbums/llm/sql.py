"""The same results in SQL, for the queries that have an SQL form."""

from __future__ import annotations

_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(pattern: str, text: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


OP1 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'row ' || row_number() OVER ()) AS copy, {_words(_SPACED, 'text')} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5),
twice AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM windows JOIN twice USING (doc_id, g), unnest(range(i, i + 5)) AS t(p) GROUP BY 1),
lines AS (SELECT doc_id, source, copy, line, array_to_string({_words(_SPACED, "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, ' ') AS k
  FROM (SELECT doc_id, source, copy, unnest(string_split(text, chr(10))) AS line FROM d)),
worded AS (SELECT *, len(string_split(k, ' ')) AS n FROM lines WHERE k <> ''),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT copy) AS documents FROM d GROUP BY 1),
frequent AS (SELECT w.source, k FROM worded w JOIN hosts h ON w.source IS NOT DISTINCT FROM h.source
  GROUP BY w.source, k, h.documents HAVING count(DISTINCT copy) >= 10 AND count(DISTINCT copy) > h.documents * 0.02),
gone AS (SELECT doc_id, sum(n) AS n FROM worded w JOIN frequent f ON w.source IS NOT DISTINCT FROM f.source AND w.k = f.k GROUP BY 1),
base AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  coalesce(dups.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(w) - coalesce(gone.n, 0) AS n_left
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(n_left AS BIGINT) AS n_left,
  NOT base_failed AND n_left >= 10 AND 100 * n_left >= 30 * n_words AS kept FROM judged
"""

OP3 = f"""
WITH items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_words(_LETTERS, _LOWER)} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM items, unnest(range(1, len(w) - n + 2)) AS t(i)),
lengths AS (SELECT DISTINCT n FROM windows),
d AS (SELECT doc_id, {_words(_LETTERS, _LOWER)} AS w FROM documents),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_SPACED, _LOWER)} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * common >= 85 * (sx.n + sy.n - common)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""

# CRC-32 (reflected, polynomial 0xEDB88320) of a number's decimal digits, in list functions
_CRC_TABLE = """(SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc_table
  FROM range(256) t(n))"""
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"""

OP12 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), {_CRC_TABLE}),
rebuilt AS (SELECT i.conv_id, p AS s, role, text FROM ids i JOIN t ON t.conv_id = base AND p <= h
  UNION ALL SELECT i.conv_id, p + 3, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id AND p > h),
turns AS (SELECT i.conv_id, coalesce(w, []) AS w FROM ids i LEFT JOIN (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY s) AS w FROM rebuilt GROUP BY 1) USING (conv_id)),
nodes AS (SELECT d, w[1:d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(w) = d), '')) AS ends_sha256
  FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM turns) GROUP BY 1, 2),
childless AS (SELECT *, NOT EXISTS (SELECT 1 FROM nodes c WHERE c.d = n.d + 1 AND c.path[1:n.d] = n.path) AS leaf FROM nodes n),
up AS (SELECT path[1:j] AS path, j AS d, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len({_words(_SPACED, 'path[d].t')}) END AS saved, leaf, d - j AS below
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM childless)),
sums AS (SELECT d, path, count(*) FILTER (below = 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.path = n.path LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""

ORACLE_SQL = {"op1_line_frequency": OP1, "op3_prefix_filter": OP3, "op4_chosen_path": OP4, "op12_block_hashing": OP12}
