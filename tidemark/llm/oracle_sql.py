"""DuckDB statements for the queries that SQL can express, in their plainest form."""

from __future__ import annotations

from tidemark.llm import block_knn, embed_dedup, license_scan, warc

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"regexp_extract_all({_LOWER}, '{_WORDS}')"


def _templates() -> str:
    rows = []
    for k, (text, label, phrase, must) in enumerate(
            [(t, n, True, t) for t, n in license_scan.PHRASES] +
            [(t, n, False, must) for t, n, must in license_scan.NOTICES]):
        distinct = len(set(text.split()))
        share = 1 if phrase or distinct <= license_scan.ALL_WORDS_UP_TO else license_scan.THRESHOLD
        rows.append(f"({k}, '{text}', '{label}', {phrase}, {share}, '{must}')")
    return ", ".join(rows)


OP2 = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
t AS (SELECT k, phrase_text, label, is_phrase, string_split(phrase_text, ' ') AS own, share, string_split(must_text, ' ') AS must
      FROM (VALUES {_templates()}) AS v(k, phrase_text, label, is_phrase, share, must_text)),
place AS (
  SELECT doc_id, label, s - 1 AS spot
  FROM (SELECT doc_id, w, own, label, phrase_text, unnest(generate_series(1, len(w) - len(own) + 1)) AS s
        FROM d, t WHERE is_phrase AND len(w) >= len(own))
  WHERE array_to_string(w[s:s + len(own) - 1], ' ') = phrase_text),
block AS (
  SELECT doc_id, b, list_distinct(w[b + 1:b + {license_scan.BLOCK}]) AS has
  FROM (SELECT doc_id, w, unnest(generate_series(
          0, greatest(len(w) - {license_scan.BLOCK - license_scan.STRIDE}, 1) - 1, {license_scan.STRIDE})) AS b
        FROM d WHERE len(w) > 0)),
found AS (
  SELECT doc_id, b, label, is_phrase,
         CAST(len(list_intersect(has, list_distinct(own))) AS DOUBLE) / len(list_distinct(own)) AS part
  FROM block, t
  WHERE list_has_all(has, must) AND len(list_intersect(has, list_distinct(own))) >= ceil(share * len(list_distinct(own)))),
base AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM place GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM found WHERE NOT is_phrase)
  GROUP BY doc_id),
method AS (
  SELECT doc_id, max(CASE WHEN NOT is_phrase THEN part END) AS best, count(DISTINCT b) AS n_blocks
  FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score,
       CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN method USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item, n, array_to_string(w[j:j + n - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n,
               unnest(generate_series(1, greatest(len(w) - 9, 1))) AS j FROM i WHERE len(w) > 0)),
doc_window AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM d, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, s, item FROM doc_window JOIN item_window USING (n, win)),
covered AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS at FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT}
                 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM f
"""

OP6 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {embed_dedup.COSINE}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, c.component_id,
       e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c USING (vec_id)
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: eight shifts a byte, both as list reductions."""
    step = ("list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], "
            "lambda x, i: xor(x >> 1, (x & 1) * 3988292384))")
    chars = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {chars}), lambda c, b: {step}), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"


OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
              ELSE {_leaf('text')} END AS shown
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
node AS (
  SELECT source, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM node WHERE n > 1 GROUP BY source, lvl, pos // 3),
sub AS (
  SELECT source, h AS subroot, lvl AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
  FROM node WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM upper WHERE n > 1 GROUP BY lvl, pos // 3),
step AS (
  SELECT l.source, l.pos AS leaf_pos, a.lvl,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < a.pos), '') AS lo,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > a.pos), '') AS hi
  FROM leaves l JOIN node a ON l.source IS NOT DISTINCT FROM a.source AND a.n > 1
                            AND a.pos = l.pos // CAST(pow(3, a.lvl) AS BIGINT)
  JOIN node s ON s.source IS NOT DISTINCT FROM a.source AND s.lvl = a.lvl AND s.pos // 3 = a.pos // 3
  GROUP BY l.source, l.pos, a.lvl),
upper_step AS (
  SELECT b.source, b.top + a.lvl AS lvl,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < a.pos), '') AS lo,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > a.pos), '') AS hi
  FROM sub b JOIN upper a ON a.n > 1 AND a.pos = b.pos // CAST(pow(3, a.lvl) AS BIGINT)
  JOIN upper s ON s.lvl = a.lvl AND s.pos // 3 = a.pos // 3
  GROUP BY b.source, b.top, a.lvl),
path AS (
  SELECT source, leaf_pos, lvl, lo, hi FROM step
  UNION ALL
  SELECT l.source, l.pos, u.lvl, u.lo, u.hi FROM leaves l JOIN upper_step u ON l.source IS NOT DISTINCT FROM u.source),
fold AS (
  SELECT source, pos, 0 AS lvl, shown AS h FROM leaves
  UNION ALL
  SELECT f.source, f.pos, f.lvl + 1, sha256(p.lo || f.h || p.hi)
  FROM fold f JOIN path p ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.leaf_pos AND f.lvl = p.lvl),
folded AS (SELECT source, pos, arg_max(h, lvl) AS folded_root FROM fold GROUP BY source, pos),
proof AS (SELECT source, leaf_pos AS pos, string_agg(lo || hi, '' ORDER BY lvl) AS siblings FROM path GROUP BY source, leaf_pos)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.folded_root,
       f.folded_root = r.h AS verified
FROM leaves l JOIN sub s ON l.source IS NOT DISTINCT FROM s.source
JOIN folded f ON l.source IS NOT DISTINCT FROM f.source AND l.pos = f.pos
LEFT JOIN proof p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.pos
JOIN upper r ON r.n = 1
"""

OP12 = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {block_knn.K}
"""

OP13 = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY n) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, {_crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM own),
conv AS (
  SELECT a.conv_id AS conv, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
member AS (
  SELECT conv, len(turns) AS len, d AS depth, turns[1:d] AS path, CASE WHEN d > 0 THEN turns[1:d - 1] END AS up
  FROM (SELECT *, unnest(generate_series(0, len(turns))) AS d FROM conv)),
node AS (
  SELECT depth, path, any_value(up) AS up, min(conv) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (len = depth), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(path[depth].text), '[^\\x20\\x09-\\x0D]+')), 0) AS own_saved
  FROM member GROUP BY depth, path),
child AS (SELECT up AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY up),
whole AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (path)),
above AS (SELECT conv_id, own_saved, n_children, path[1:unnest(generate_series(0, depth))] AS path FROM whole),
below AS (
  SELECT path, sum(own_saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY path)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs,
       CAST(w.n_children AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below b USING (path) LEFT JOIN node p ON w.depth > 0 AND p.path = w.up
"""
