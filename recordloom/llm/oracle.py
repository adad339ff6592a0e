"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

OP11_FIM = r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), numbered AS (
    SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM hashed
), formed AS (
    SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbered
), cut AS (
    SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM formed
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
           ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""

_STEPS = " UNION ALL ".join(f"SELECT {i} AS step" for i in range(1, 6))

OP12_FILTERS = rf"""
WITH base AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), marked AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM base
), firsts AS (
    SELECT text, min(doc_id) AS first_id FROM base GROUP BY text
), marks AS (
    SELECT l.doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS bad
    FROM labels l GROUP BY l.doc_id
), failing AS (
    SELECT b.part, coalesce(k.good, 0) AS good, coalesce(k.bad, 0) AS bad,
        (CASE WHEN len(w.words) < 50 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(w.words)) < 65 * len(w.words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(b.text, '[^A-Z]+', '', 'g')) > 5 * length(b.text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(b.text, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN b.doc_id > f.first_id THEN 16 ELSE 0 END) AS mask
    FROM base b
    JOIN (SELECT DISTINCT text, words FROM marked) w ON w.text = b.text
    JOIN firsts f ON f.text = b.text
    LEFT JOIN marks k ON k.doc_id = b.doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failing GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f
      AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f
), removal AS (
    SELECT c.part, o.filter_order, c.mask, c.n, c.good, c.bad,
        coalesce((SELECT min(instr(o.filter_order, l.f)) FROM letters l WHERE c.mask & l.bit > 0), 6) AS gone
    FROM counts c, orders o
), audit AS (
    SELECT r.part, r.filter_order, s.step, l.f, l.bit,
        sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & l.bit > 0 AND gone < step THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = l.bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN gone = step THEN bad ELSE 0 END) AS toxic_lost
    FROM removal r, ({_STEPS}) s, letters l
    WHERE l.f = r.filter_order[s.step]
    GROUP BY r.part, r.filter_order, s.step, l.f, l.bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM audit
"""

ORACLE_SQL: dict[str, str] = {"op11_fim": OP11_FIM, "op12_filters": OP12_FILTERS}
