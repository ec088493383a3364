"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op7_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_CHARS}'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '{_CHARS}'), []) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (
    SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
  )
), spots AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k
  )
), hit AS (SELECT spots.doc_id, spots.i, spots.k, win.item_id FROM spots JOIN win ON spots.k = win.k AND spots.t = win.t
), words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s COLLATE "C") AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_MARKS = r"([\[<])(\\*)((?:/?(?:INST|SYS|ROLE)|ANS|NEXT|TEXT)\]|/?s>)"

SQL["op13_chat_format"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)
), e AS (
  SELECT *, length(regexp_replace(text, '{_MARKS}', '\1\\\2\3', 'g')) AS n,
    length(regexp_replace(role, '{_MARKS}', '\1\\\2\3', 'g')) AS n_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS joined
  FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE WHEN joined THEN 8 WHEN role = 'system' THEN 13 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 10
    ELSE 21 + n_role END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry; the nearest is the smallest distance * entries + entry."""
    distance = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT row, vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(part)
), c0 AS MATERIALIZED (
  SELECT part, rank - 1 AS entry, min(x) AS x FROM (SELECT *, dense_rank() OVER (ORDER BY vec_id) AS rank FROM p WHERE vec_id IS NOT NULL)
  WHERE rank <= {entries} GROUP BY part, rank
)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT p.row, p.part, min({distance} * {entries} + c.entry) AS m FROM p JOIN c{i} c USING (part) GROUP BY p.row, p.part
)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (
  SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM (
    SELECT part, m % {entries} AS entry, unnest(range(len(p.x))) AS place, unnest(p.x) AS x FROM a{i} JOIN p USING (row, part)
  ) GROUP BY part, entry, place
), c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(u.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT part, entry, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY place) AS x FROM s{i} GROUP BY part, entry
  ) u ON c.part = u.part AND c.entry = u.entry
)""")
    return ",".join(steps) + f"""
, done AS (
  SELECT kept.row, any_value(vec_id) AS vec_id, any_value(label) AS label, CAST(sum(m // {entries}) AS BIGINT) AS error,
    string_agg(lpad(to_hex(m % {entries}), 2, '0'), '' ORDER BY part) AS code
  FROM a{rounds} JOIN kept USING (row) GROUP BY kept.row
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM done
"""


SQL["op12_vector_codes"] = _vector_codes()
