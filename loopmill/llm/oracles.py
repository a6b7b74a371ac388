"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from loopmill.llm.chat import CHUNK_TURNS

_CHAT = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS rank
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS own, role AS speaker FROM turns WHERE role <> 'system'),
views AS (
  SELECT conv_id, speaker, rank // {CHUNK_TURNS} AS chunk, rank, role = speaker AS own_turn,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role
           ELSE 'user name=' || translate(replace(role, '<|', '< |'), chr(13) || chr(10) || chr(9) || ' ', '____') END || chr(10) AS head,
         text || '<|im_end|>' AS said
  FROM turns JOIN people ON conv_id IS NOT DISTINCT FROM own),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, speaker, chunk ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM views)
SELECT conv_id, speaker, CAST(chunk AS BIGINT) AS chunk, count(*) AS turns, count(*) FILTER (WHERE own_turn) AS own_turns,
       sha256(string_agg(head || said || chr(10), '' ORDER BY rank)) AS rendered_sha256,
       CAST(sum(length(head) + length(said) + 1) AS BIGINT) AS rendered_chars,
       coalesce(string_agg(CAST(place + length(head) AS BIGINT) || '+' || length(said), ',' ORDER BY rank) FILTER (WHERE own_turn), '') AS masks
FROM placed GROUP BY conv_id, speaker, chunk
"""

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS original FROM d),
b AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
      (CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM o)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM b
"""

_PHRASES = """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS words FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.*, cut, l.n AS l, r.n AS r, (CAST(a AS HUGEINT) * a * 1000000) // (CAST(l.n AS HUGEINT) * r.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(words[1:cut], ' ') AND l.k = cut
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(words[cut + 1:], ' ') AND r.k = c.k - cut),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.phrase = lowest.phrase
  WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(totals.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

ORACLES = {"op3_warc": _WARC, "op4_chat": _CHAT, "op13_collocations": _PHRASES}
