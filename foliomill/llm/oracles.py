"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP10 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_SPACES}), {_AZ}) AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (frequent.k IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
    FILTER (frequent.k IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (k) GROUP BY doc_id
"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP8 = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents
), lines AS (
  SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM w
), said AS (
  SELECT doc_id, host, line, translate(trim(line, {_SPACES}), {_AZ}) AS k,
    len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
  FROM lines WHERE trim(line, {_SPACES}) <> ''
), dup AS (
  SELECT doc_id, sum(c - 1) AS n_dup_lines
  FROM (SELECT doc_id, line, count(*) AS c FROM said GROUP BY ALL) GROUP BY doc_id
), hosts AS (
  SELECT host, count(*) AS host_docs FROM w GROUP BY host
), over AS (
  SELECT host, k, min(doc_id) AS keeper FROM said JOIN hosts USING (host)
  GROUP BY host, k, host_docs
  HAVING count(DISTINCT doc_id) > 50 AND count(DISTINCT doc_id) > 0.01 * host_docs
), lost AS (
  SELECT doc_id, sum(n) AS lost_words FROM said JOIN over USING (host, k)
  WHERE doc_id <> keeper GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND n_words - lost_words >= 0.3 * n_words AS kept
FROM counts
"""

_ITEM_WORDS = (
    f"list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

OP9 = f"""
WITH d AS (
  SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents
), b AS (
  SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, ws[i:i + 9] AS win, least(len(ws), 10) AS size
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT size FROM win
), spans AS (
  SELECT doc_id, size, i, ws[i:i + size - 1] AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes)
), hits AS (
  SELECT doc_id, i, spans.size, item_id FROM spans JOIN win ON spans.win = win.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP12 = f"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS said
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)
), worded AS (
  SELECT lang, list_filter(string_split_regex(said, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) sizes(k))
), counts AS MATERIALIZED (
  SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), phrases AS MATERIALIZED (
  SELECT *, string_split(g, ' ') AS ws FROM counts WHERE k > 1 AND a >= 10
), halves AS MATERIALIZED (
  SELECT lang, k, g, a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM phrases)
), cuts AS (
  SELECT h.lang, h.k, h.g, h.a, c, x.a AS l, y.a AS r,
    CAST(1000000::HUGEINT * h.a * h.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM halves h JOIN counts x ON x.lang = h.lang AND x.g = h.head JOIN counts y ON y.lang = h.lang AND y.g = h.rest
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1
), inside AS (
  SELECT lang, g, max(a) AS most
  FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS g
    FROM phrases WHERE k = 3
  ) GROUP BY lang, g
)
SELECT scored.lang, row_number() OVER (PARTITION BY scored.lang
    ORDER BY score DESC, a DESC, g) AS rank,
  g AS phrase, a, l, r, n, score
FROM scored JOIN totals USING (lang) LEFT JOIN inside USING (lang, g)
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""


def _marked(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_marked, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: CRC-32 of decimal digits, a bit at a time: each digit is mixed in and followed by eight shifts.
_CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS told
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), low(tree, level, pos, n, digest) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY tree, level, n, pos // 2
), subroots AS (
  SELECT tree, digest, level AS levels FROM low WHERE n = 1
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM subroots
), high(level, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM ranked
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY level, n, pos // 2
), steps AS (
  SELECT p.tree, p.pos, p.level, (p.pos >> p.level) & 1 AS odd, s.digest AS sibling
  FROM (SELECT tree, pos, unnest(range(levels)) AS level FROM placed JOIN subroots USING (tree)) p
  LEFT JOIN low s ON s.tree = p.tree AND s.level = p.level AND s.pos = xor(p.pos >> p.level, 1)
  UNION ALL
  SELECT p.tree, p.pos, p.levels + p.level, (p.rank >> p.level) & 1, s.digest
  FROM (
    SELECT placed.tree, placed.pos, levels, ranked.pos AS rank,
      unnest(range((SELECT max(level) FROM high))) AS level
    FROM placed JOIN ranked USING (tree)
  ) p LEFT JOIN high s ON s.level = p.level AND s.pos = xor(p.rank >> p.level, 1)
), folded(tree, pos, level, node) AS (
  SELECT tree, pos, 0, told FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(CASE WHEN s.odd = 1 THEN coalesce(sibling, '') || node
    ELSE node || coalesce(sibling, '') END)
  FROM folded f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level
), proofs AS (
  SELECT tree, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256, count(*) AS height
  FROM steps GROUP BY tree, pos
), top AS (
  SELECT digest AS root FROM high WHERE n = 1
)
SELECT doc_id, leaf, subroots.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  node AS folded_root, node = root AS verified
FROM placed JOIN subroots USING (tree) CROSS JOIN top LEFT JOIN proofs USING (tree, pos)
JOIN folded ON folded.tree = placed.tree AND folded.pos = placed.pos AND folded.level = coalesce(height, 0)
"""

ORACLES = {
    "op8_quality_rules": OP8,
    "op9_decontaminate": OP9,
    "op10_line_dedup": OP10,
    "op12_phrases": OP12,
    "op13_merkle": OP13,
}
