"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op5_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM pos),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS t(o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      | CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END | CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
      | CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END | CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
      | CASE WHEN 100 * n_upper > 60 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, n_lines, n_upper FROM b
"""

ORACLES["op8_sharding"] = r"""
WITH k AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
s AS (SELECT doc_id, key, strlen(text)::BIGINT + 8 AS size, text,
             list_max(list_transform(range(24), lambda i: {'v': substr(md5(key || ':' || i::VARCHAR), 1, 13), 's': i::INTEGER})).s AS shard,
             list_max(list_transform(range(25), lambda i: {'v': substr(md5(key || ':' || i::VARCHAR), 1, 13), 's': i::INTEGER})).s AS grown_shard FROM k),
c AS (SELECT *, list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
             lambda x, u: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS tab FROM (SELECT 1)),
h AS (SELECT s.doc_id, s.key, s.size, s.shard, s.grown_shard,
             xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(list_filter(range(0, 2 * (s.size - 8), 2), lambda p: true),
             lambda p: ('0x' || substr(hex(encode(s.text)), p + 1, 2))::UBIGINT)), lambda a, x: xor(a >> 8, c.tab[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM s, c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(key), text_crc32) - 1 AS slot, grown_shard FROM h
"""

ORACLES["op4_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS g FROM win),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY g) AS f FROM k) WHERE f < {'d': doc_id, 'i': i}),
gap AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit),
n AS (SELECT doc_id, sum(least(20, coalesce(nxt - i, 20)))::BIGINT AS n_removed, count(*) FILTER (nxt IS NULL OR nxt > i + 20)::BIGINT AS n_spans FROM gap GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM hit),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.j) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

ORACLES["op6_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g FROM pos),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
"""

ORACLES["op9_suffix_array"] = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
win AS (SELECT doc_id, t, unnest(range(0, strlen(t) // 2 - 49)) AS i FROM h WHERE strlen(t) >= 100),
k AS (SELECT doc_id, i, md5_number(substr(t, 2 * i + 1, 100)) AS g FROM win),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM k) WHERE f < doc_id),
gap AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prv FROM hit),
n AS (SELECT doc_id, sum(least(50, coalesce(nxt - i, 50)))::BIGINT AS n_removed, count(*) FILTER (nxt IS NULL OR nxt > i + 50)::BIGINT AS n_spans FROM gap GROUP BY doc_id),
ends AS (SELECT doc_id, i + 50 AS a FROM gap WHERE nxt IS NULL OR nxt > i + 50 UNION ALL SELECT doc_id, 0 FROM h),
starts AS (SELECT doc_id, i AS b FROM gap WHERE prv IS NULL OR i > prv + 50 UNION ALL SELECT doc_id, strlen(t) // 2 FROM h),
ea AS (SELECT doc_id, a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM ends),
sb AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS k FROM starts),
kept AS (SELECT h.doc_id, string_agg(substr(t, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS t FROM h JOIN ea ON ea.doc_id = h.doc_id JOIN sb ON sb.doc_id = ea.doc_id AND sb.k = ea.k WHERE b > a GROUP BY h.doc_id)
SELECT h.doc_id, (strlen(h.t) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.t, ''))) AS kept_sha256
FROM h LEFT JOIN n ON n.doc_id = h.doc_id LEFT JOIN kept ON kept.doc_id = h.doc_id
"""

ORACLES["op10_embeddings"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""

ORACLES["op7_mixing"] = r"""
WITH RECURSIVE src AS (SELECT coalesce(source, chr(1)) AS s, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY 1),
k AS (SELECT list(s ORDER BY s) AS ss, list(n ORDER BY s) AS ns, list(w ORDER BY s) AS ws, greatest(16, (sum(n) + 65535) // 65536)::BIGINT AS size FROM src HAVING count(*) > 0),
h AS (SELECT ss, ns, size, list_transform(ns, lambda n: ((n + size - 1) // size)::BIGINT) AS bs,
        list_transform(ws, lambda w: greatest(1, floor(w / list_reduce(list_prepend(0.0::DOUBLE, ws), lambda a, x: a + x) * 1099511627776 + 0.5))::BIGINT) AS p FROM k),
r(slot, t, total, pick, block, first, ok, done, turn) AS (
  SELECT -1::BIGINT, -1::BIGINT, list_sum(p)::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true, list_transform(p, lambda x: 0::BIGINT), list_transform(p, lambda x: 0::BIGINT) FROM h
  UNION ALL
  SELECT slot + 1, nt, total, i, done[i], nf, nok, list_transform(done, lambda x, j: CASE WHEN j = i THEN x + 1 ELSE x END), list_transform(nturn, lambda x, j: CASE WHEN j = i THEN x + 1 ELSE x END)
  FROM (SELECT slot, nt, ntotal AS total, done, nturn, nf, nok,
      list_min(list_transform(list_filter(range(1, len(p) + 1), lambda j: done[j] < bs[j] AND (nturn[j] * ntotal) // p[j] <= nt), lambda j: {'d': ((nturn[j] + 1) * ntotal + p[j] - 1) // p[j], 'i': j::BIGINT})).i AS i
    FROM (SELECT slot, h.p, h.bs, done, CASE WHEN dry THEN 0 ELSE t + 1 END AS nt, CASE WHEN dry THEN list_transform(turn, lambda x: 0::BIGINT) ELSE turn END AS nturn, ok AND NOT dry AS nok,
        CASE WHEN dry THEN list_sum(list_transform(h.p, lambda x, j: CASE WHEN done[j] < h.bs[j] THEN x ELSE 0 END))::BIGINT ELSE total END AS ntotal,
        CASE WHEN pick = 0 THEN 0 ELSE first + least(h.size, h.ns[pick] - block * h.size) END AS nf
      FROM (SELECT r.*, coalesce(pick > 0 AND done[pick] = h.bs[pick], false) AS dry FROM r, h) AS r, h WHERE list_sum(done) < list_sum(h.bs)))),
d AS (SELECT doc_id, source, coalesce(source, chr(1)) AS s, row_number() OVER (PARTITION BY coalesce(source, chr(1)) ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id) - 1 AS idx FROM documents),
b AS (SELECT d.*, idx // h.size AS block, h.size, list_position(h.ss, d.s) AS i, h.p[list_position(h.ss, d.s)] / list_sum(h.p)::BIGINT AS target_weight FROM d, h)
SELECT b.doc_id, b.source, b.block, r.slot AS mix_slot, (r.first + b.idx % b.size)::BIGINT AS position, b.target_weight, r.ok AS in_target FROM b JOIN r ON r.slot >= 0 AND r.pick = b.i AND r.block = b.block
"""
