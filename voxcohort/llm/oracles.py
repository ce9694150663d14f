"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .mixing import CALIBRATIONS, MARGINS, ROUNDS, TEMPERATURE

#: [\x20\x09-\x0D], and the lower-casing of A-Z alone.
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, i, line, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM lines
), gone AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS dropped FROM keyed k LEFT JOIN gone g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = """
WITH RECURSIVE bits(b, c, i) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
docs AS (
  SELECT doc_id, coalesce(text, '') AS s, hex(encode(coalesce(text, ''))) AS h, sha256(coalesce(text, '')) AS k FROM documents
), rows AS (
  SELECT doc_id, k[1:15] AS k, (length(h) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_transform(range(0, length(h) // 2), lambda j: ('0x' || h[2 * j + 1 : 2 * j + 2])::BIGINT),
      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM docs, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY k, doc_id) - size AS start, row_number() OVER (ORDER BY k, doc_id) - 1 AS ordinal, sum(size) OVER () AS total FROM rows
), grouped AS (
  SELECT *, min(start) OVER (PARTITION BY k) AS g0, sum(size) OVER (PARTITION BY k) AS gs FROM placed
), dealt AS (
  SELECT doc_id, size, text_crc32, ordinal, least(15, floor((CASE WHEN gs * 16 <= 0.01 * total THEN 2 * g0 + gs ELSE 2 * start + size END) * 16 / (2 * total)))::INTEGER AS shard FROM grouped
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (ordinal - min(ordinal) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM dealt
"""


def _op1(fraction: float = 0.5, seed: int = 17) -> str:
    spaced = "translate(s, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
    parts = [
        "WITH docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS s FROM documents)",
        f"""counted AS (SELECT doc_id, source, lang,
          CASE WHEN contains(s, ' | ') THEN 'table' WHEN contains(s, 'http') OR contains(s, '@') THEN 'linked' WHEN contains(s, chr(10)) THEN 'prose' ELSE 'line' END AS topic,
          len(list_filter(string_split({spaced}, ' '), lambda w: w <> ''))::BIGINT AS n_tokens,
          ('0x' || substr(md5('{seed}/' || doc_id || '/' || md5(s)), 1, 13))::BIGINT / 4503599627370496.0 AS draw FROM docs)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"goal_{m} AS MATERIALIZED (SELECT {m}, power(t, {float(TEMPERATURE[m])!r}::DOUBLE) / sum(power(t, {float(TEMPERATURE[m])!r}::DOUBLE)) OVER () AS goal FROM (SELECT {m}, sum(tokens)::DOUBLE AS t FROM cells GROUP BY 1) WHERE t > 0)")
    parts.append("w0 AS MATERIALIZED (SELECT c.*, 1.0::DOUBLE AS weight, gs.goal AS goal_s, gl.goal AS goal_l, gt.goal AS goal_t FROM cells c LEFT JOIN goal_source gs ON c.source IS NOT DISTINCT FROM gs.source LEFT JOIN goal_lang gl ON c.lang IS NOT DISTINCT FROM gl.lang LEFT JOIN goal_topic gt ON c.topic IS NOT DISTINCT FROM gt.topic)")
    last, k = "w0", 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            k += 1
            parts.append(f"w{k} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * (goal_{m[0]} * sum(tokens * weight) OVER () / nullif(sum(tokens * weight) OVER (PARTITION BY {m}), 0)), 0) AS weight) FROM {last})")
            last = f"w{k}"
    parts.append(f"p0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS probability, {fraction}::DOUBLE * sum(tokens) OVER () AS budget FROM {last})")
    for i in range(CALIBRATIONS):
        scale = "(budget - coalesce(sum(tokens) FILTER (WHERE probability >= 1) OVER (), 0)) / nullif(sum(tokens * weight) FILTER (WHERE probability < 1) OVER (), 0)"
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN probability >= 1 THEN 1.0 ELSE coalesce(least(1.0, greatest(0.0, {scale} * weight)), 0.0) END AS probability) FROM p{i})")
    return ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.weight, 6) AS cell_weight, round(p.probability, 6) AS probability, d.draw < p.probability AS selected
FROM counted d JOIN p{CALIBRATIONS} p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic"""


OP10 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words
), items AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT x.doc_id, l.b FROM reach x JOIN links l ON l.a = x.r
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""

OP5 = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT x.vec_id, l.b FROM reach x JOIN links l ON l.a = x.r
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) c ON v.vec_id = c.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
"""

ORACLES = {"op5_embedding_dedup": OP5, "op10_near_dup": OP10, "op1_mix": _op1(), "op4_line_dedup": OP4, "op8_shard": OP8}
