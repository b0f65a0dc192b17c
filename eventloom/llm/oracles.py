"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TOPK = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS i, embedding AS e, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x, len(embedding) AS n
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT * FROM v WHERE vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n, e) = 1
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS s
  FROM q JOIN v c ON q.n = c.n AND q.i <> c.i
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r
  FROM (SELECT query_id, vec_id, CAST(greatest(least(coalesce(s, 0), 9223372036854775807), -9223372036854775808) AS BIGINT) AS score FROM s)) WHERE r <= 5
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM k JOIN f USING (k) WHERE m < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

URLS = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS k
  FROM u
), s AS (
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS v,
    list_transform(k, lambda x: regexp_replace(x, '[0-9]+', '*', 'g')) AS g
  FROM r
), c0 AS (SELECT host, g, count(*) AS n, count(*) FILTER (v = 'block') AS b, count(v) AS l, '' AS t FROM s GROUP BY ALL),
"""
#: Levels of the tree; the tables' paths have fewer segments.
_LEVELS = 5
_KINDS = ("e", "d", "m", "w")


def _apart(x: str, n: str) -> str:
    share = f"(({x} + a.{x} + 1)::DOUBLE / ({n} + a.{n} + 2))"
    return f"coalesce(abs({x}::DOUBLE / nullif({n}, 0) - a.{x}::DOUBLE / nullif(a.{n}, 0)) > 2.0 * sqrt({share} * (1 - {share}) * (1.0::DOUBLE / nullif({n}, 0) + 1.0::DOUBLE / nullif(a.{n}, 0))), false)"


for _d in range(1, _LEVELS + 1):
    _kind = f"CASE WHEN len(g) < {_d + 1} THEN 'e' WHEN g[{_d + 1}] = '*' THEN 'd' WHEN contains(g[{_d + 1}], '*') THEN 'm' ELSE 'w' END"
    _sums = ", ".join(f"sum(CASE WHEN {_kind} = '{k}' THEN n ELSE 0 END) AS {k}" for k in _KINDS)
    _differ = " OR ".join([_apart("b", "l"), *(_apart(k, "n") for k in _KINDS)])
    URLS += f"""
o{_d} AS (SELECT *, len(g) >= {_d} AND sum(n) OVER (PARTITION BY host, t) >= 6 AS open FROM c{_d - 1}),
k{_d} AS (SELECT host, t, g[{_d}] AS x, sum(n) AS n, sum(b) AS b, sum(l) AS l, {_sums} FROM (SELECT * FROM o{_d} WHERE open) GROUP BY ALL),
v{_d} AS (SELECT *, CASE WHEN count(*) OVER w > 8 AND 2 * count(*) OVER w > sum(n) OVER w THEN '/*' END AS part FROM k{_d} WINDOW w AS (PARTITION BY host, t)),
a{_d} AS (SELECT host, t, arg_max(struct_pack(n := n, b := b, l := l, e := e, d := d, m := m, w := w), (l, n, x)) AS a FROM v{_d} WHERE part IS NULL AND n >= 6 GROUP BY ALL),
f{_d} AS (SELECT v.* REPLACE (CASE WHEN part IS NULL AND n >= 6 AND NOT ({_differ}) THEN '/~1' ELSE part END AS part) FROM v{_d} v LEFT JOIN a{_d} USING (host, t)),
h{_d} AS (SELECT host, t, arg_max(struct_pack(n := n, b := b, l := l, e := e, d := d, m := m, w := w), (l, n, x)) AS a FROM f{_d} WHERE part IS NULL AND n >= 6 GROUP BY ALL),
j{_d} AS (SELECT f.host, f.t, f.x, coalesce(part, CASE WHEN n >= 6 AND a IS NOT NULL AND NOT ({_differ}) THEN '/~2' END, '/' || x) AS part FROM f{_d} f LEFT JOIN h{_d} USING (host, t)),
c{_d} AS (SELECT o.host, g, n, b, l, o.t || part AS t FROM o{_d} o JOIN j{_d} j ON o.host = j.host AND o.t = j.t AND o.g[{_d}] = j.x AND open),"""
_ALL = " UNION ALL ".join(f"SELECT host, g, b, l, t FROM o{_d} WHERE NOT open" for _d in range(1, _LEVELS + 1))
URLS += f"""
z AS ({_ALL} UNION ALL SELECT host, g, b, l, t FROM c{_LEVELS}),
q AS (SELECT host, t, (sum(b) + 2.0::DOUBLE) / (sum(l) + 4.0::DOUBLE) AS purity FROM z GROUP BY host, t),
m AS (SELECT host, g, purity FROM z JOIN q USING (host, t))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict FROM s LEFT JOIN m USING (host, g)
"""

MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), e AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS x FROM d
), f AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM e
), g AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""

_NEAREST = "SELECT vec_id, i, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, i, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{0}) GROUP BY ALL"
CENTROIDS = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS i, embedding AS e, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS k, x AS c FROM v QUALIFY k < 16),
"""
for _r in range(3):
    CENTROIDS += f"""
n{_r} AS MATERIALIZED ({_NEAREST.format(_r)}),
s{_r} AS MATERIALIZED (SELECT k, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, unnest(range(64)) AS j FROM n{_r}) GROUP BY ALL),
c{_r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{_r} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{_r} GROUP BY k) USING (k)),"""
CENTROIDS += f"""
z AS MATERIALIZED ({_NEAREST.format(3)})
SELECT vec_id, CAST(z.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM z JOIN c3 USING (k)
"""

ORACLES: dict[str, str] = {"op4_urls": URLS, "op6_topk": TOPK, "op8_substrings": SUBSTRINGS, "op11_centroids": CENTROIDS, "op12_middle": MIDDLE}
