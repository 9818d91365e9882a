"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_ITEM_WORDS}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : least(i + 9, len(w))], ' ') AS g, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORDS}') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM win), grams AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (
  SELECT r, i, n, item_id FROM grams JOIN win USING (n, g)
), cover AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) % (len(u) + 1) AS h1,
    CAST('0x' || s[9:16] AS BIGINT) % (len(u) + 1) AS h2, CAST('0x' || s[25:32] AS BIGINT) % 100 AS h4,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d
), c AS (
  SELECT *, array_to_string(u[1 : least(h1, h2)], '') AS p,
    array_to_string(u[least(h1, h2) + 1 : greatest(h1, h2)], '') AS m,
    array_to_string(u[greatest(h1, h2) + 1 :], '') AS x FROM h
), f AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN NOT plain THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN NOT plain THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
    ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""

ORACLES = {"op4_benchmark_decontamination": DECONTAMINATION, "op11_fill_in_middle": FILL_IN_MIDDLE}
