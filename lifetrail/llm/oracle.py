"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op4_license_join"] = r"""
WITH notices(k, label, notice) AS (VALUES
    (1, 'mit', 'released under the mit license'),
    (2, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
    (3, 'apache', 'licensed under the apache license version 2 0'),
    (4, 'gpl', 'this work is licensed under the gnu general public license version 3'),
    (5, 'gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license'),
    (6, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
    (7, 'mpl', 'this source code form is subject to the terms of the mozilla public license v 2 0'),
    (8, 'cc-by-nc', 'licensed under cc by nc 4 0'),
    (9, 'cc', 'licensed under the creative commons attribution 4 0 international license')),
templates AS (
    SELECT k, label, list_distinct(ws) AS words, len(list_distinct(ws)) AS size, ceil(0.8 * len(list_distinct(ws)) - 1e-9) AS need, ceil(len(ws) / 0.8 - 1e-9) AS width
    FROM (SELECT k, label, string_split(notice, ' ') AS ws FROM notices)),
d AS (
    SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (
    SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
p AS MATERIALIZED (SELECT r, i, ws[i + 1] AS word, ws[i + 2] AS word2, ws[i + 3] AS word3 FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM w)),
places AS MATERIALIZED (
    SELECT r, i AS word, 'mit' AS label FROM p WHERE p.word = 'mit' AND word2 = 'license'
    UNION ALL
    SELECT r, i, 'apache' FROM p WHERE p.word = 'apache' AND word2 = 'license'
    UNION ALL
    SELECT r, i, 'gpl' FROM p WHERE p.word = 'general' AND word2 = 'public' AND word3 = 'license'),
-- every place of a template's word, and the template's words in the window that starts there
held AS MATERIALIZED (SELECT p.r, p.i, p.word, k, label, size, need, width FROM (SELECT k, label, size, need, width, unnest(words) AS word FROM templates) t JOIN p ON p.word = t.word),
windows AS (
    SELECT a.r, a.k, a.i, any_value(a.label) AS label, any_value(a.size) AS size, any_value(a.need) AS need, count(DISTINCT b.word) AS overlap
    FROM held a JOIN held b ON b.r = a.r AND b.k = a.k AND b.i >= a.i AND b.i < a.i + a.width GROUP BY a.r, a.k, a.i),
met AS MATERIALIZED (SELECT r, label, max(overlap::DOUBLE / size) AS containment FROM windows WHERE overlap >= need GROUP BY r, label),
n AS (SELECT r, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM met) GROUP BY r),
s AS (SELECT r, max(containment) AS best FROM met GROUP BY r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN n USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""

ORACLE_SQL["op6_voronoi_topk"] = """
WITH x AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
    SELECT q.row AS query_row, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
    FROM x q JOIN x ON q.row <> x.row WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL["op9_int8_block_join"] = """
WITH x AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (
    SELECT q.row AS query_row, q.vec_id AS query_id, x.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
    FROM x q JOIN x ON q.row <> x.row WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_CODES_ASSIGN = """
a{r} AS MATERIALIZED (
    SELECT pt.row, pt.part, min(list_sum(list_transform(list_zip(pt.p, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.entry) AS best
    FROM pt JOIN b{r} b ON b.part = pt.part GROUP BY pt.row, pt.part),"""
_CODES_UPDATE = """
m{r} AS (
    SELECT part, entry, pos, sum(c) AS s, count(*) AS n FROM (
        SELECT a.part, a.best % 64 AS entry, unnest(pt.p) AS c, unnest(range(len(pt.p))) AS pos FROM a{r} a JOIN pt ON pt.row = a.row AND pt.part = a.part)
    GROUP BY part, entry, pos),
b{next} AS MATERIALIZED (
    SELECT part, entry, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY pos) AS e FROM m{r} GROUP BY part, entry
    UNION ALL SELECT part, entry, e FROM b{r} b WHERE NOT EXISTS (SELECT 1 FROM m{r} m WHERE m.part = b.part AND m.entry = b.entry)),"""

ORACLE_SQL["op11_equal_average_codes"] = """
WITH x AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pt AS MATERIALIZED (
    SELECT row, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS p FROM (SELECT row, v, unnest(range(16)) AS part FROM x)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, p AS e FROM pt WHERE row <= 64),
""" + "".join((_CODES_ASSIGN + (_CODES_UPDATE if r < 2 else "")).format(r=r, next=r + 1) for r in range(3)) + """
f AS (SELECT row, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY row),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS digest FROM (SELECT part, entry, unnest(e) AS c, unnest(range(len(e))) AS pos FROM b2))
SELECT x.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY x.label) AS BIGINT) AS label_error, h.digest AS codebooks_sha256
FROM x JOIN f USING (row), h
"""

ORACLE_SQL["op12_perfect_hash_audit"] = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT row, lang, source, term, count(*) AS c FROM (SELECT row, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c FROM g JOIN k ON k.lang = g.lang
    LEFT JOIN (SELECT lang, source, term, sum(c) AS c FROM w GROUP BY ALL) n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS MATERIALIZED (
    SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v) AS p FROM c JOIN v USING (lang)),
q AS MATERIALIZED (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q
    FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term) JOIN v USING (lang)),
pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
    FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source),
term AS (
    SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q),
r AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL["op13_flat_graph_dedup"] = """
WITH RECURSIVE x AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
        label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS good
    FROM embeddings),
l AS MATERIALIZED (
    SELECT a.row AS a, b.row AS b, b.vec_id FROM x a JOIN x b ON a.label = b.label AND a.row <> b.row
    WHERE a.good AND b.good AND list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.98),
reach AS (
    SELECT row AS a, row AS b, vec_id FROM x
    UNION
    SELECT r.a, l.b, l.vec_id FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(vec_id) AS component_id FROM reach GROUP BY a)
SELECT x.vec_id, (SELECT count(*) FROM l WHERE l.a = x.row) AS n_links, c.component_id, x.vec_id = c.component_id AS kept, CAST(1.0 AS DOUBLE) AS recall
FROM x JOIN c ON c.a = x.row
"""
