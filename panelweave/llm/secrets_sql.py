"""DuckDB SQL of ``op7_secrets``: the patterns as they are stated, the models counted anew, the runs scored anew."""

from __future__ import annotations

from panelweave.llm.secrets import ALPHABET, KIND, LEAST_MEAN, LEAST_RATIO, LEAST_RUN, PATTERNS, SAMPLE_DOCS, SYNTHETIC


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = rf"""(?:{_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RUN = "[A-Za-z0-9+/_=-]+"

#: Rank, pattern, its group that holds the value, and the least length of it.
_BASE = ((0, _ASSIGN, 1, 6), (1, "(AKIA[A-Z0-9]+)", 1, 20), (2, "([0-9a-f]+)", 1, 24))


def _spans(source: str, rank: int, pattern: str, least: int) -> str:
    return f"""
  SELECT doc_id, {rank} AS rank, e - length(regexp_extract(piece, '{pattern}', 0)) AS a, e, regexp_extract(piece, '{pattern}', 1) AS value
  FROM (SELECT doc_id, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e
        FROM (SELECT doc_id, unnest(x) AS piece, unnest(range(1, len(x) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(t, '(?s).*?(?:{pattern})', 0) AS x FROM {source})))
  WHERE length(regexp_extract(piece, '{pattern}', 1)) >= {least}"""


_size = len(ALPHABET)
_union = " UNION ALL ".join(_spans("d", r, p, n) for r, p, _, n in _BASE)
_kind = "CASE rank " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate([*[k for k, _ in PATTERNS], KIND])) + " END"
_listed = f"string_agg({_kind} || ':' || a || ':' || e, ',' ORDER BY a, rank, e)"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_union}),
ids AS (SELECT DISTINCT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM d ORDER BY m, doc_id LIMIT {SAMPLE_DOCS}),
rest AS (SELECT regexp_replace(regexp_replace(regexp_replace(t, '{_ASSIGN}', ' ', 'g'), 'AKIA[A-Z0-9]{{16,}}', ' ', 'g'), '[0-9a-f]{{24,}}', ' ', 'g') AS t FROM d WHERE doc_id IN (SELECT doc_id FROM ids)),
labelled AS (
  SELECT value AS s, 1 AS random FROM base WHERE doc_id IN (SELECT doc_id FROM ids)
  UNION ALL SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{4,}}')), 0 FROM rest
  UNION ALL SELECT sha256(CAST(i AS VARCHAR)), 1 FROM range({SYNTHETIC}) r(i)
  UNION ALL SELECT to_base64(unhex(sha256(CAST(i AS VARCHAR)))), 1 FROM range({SYNTHETIC}) r(i)
),
pairs AS (
  SELECT random, substr(s, i, 1) AS x, substr(s, i + 1, 1) AS y, count(*) AS n
  FROM (SELECT random, s, unnest(range(1, length(s))) AS i FROM labelled WHERE length(s) >= 2)
  WHERE regexp_matches(substr(s, i, 2), '^[A-Za-z0-9+/_=-][A-Za-z0-9+/_=-]$') GROUP BY ALL
),
totals AS (SELECT x, sum(CASE WHEN random = 1 THEN n ELSE 0 END) AS n1, sum(CASE WHEN random = 0 THEN n ELSE 0 END) AS n0 FROM pairs GROUP BY x),
found AS ({_spans("d", 3, f"({_RUN})", LEAST_RUN)}),
runs AS (
  SELECT * FROM found f WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.a < f.e AND f.a < b.e)
),
steps AS (SELECT doc_id, a, e, value, substr(value, i, 1) AS x, substr(value, i + 1, 1) AS y FROM (SELECT *, unnest(range(1, length(value))) AS i FROM runs)),
scored AS (
  SELECT s.doc_id, s.a, s.e, s.value, sum(round(1000 * ln(
    (CAST(2 * coalesce(p.n, 0) + 1 AS DOUBLE) / CAST(2 * coalesce(t.n1, 0) + {_size} AS DOUBLE)) / (CAST(2 * coalesce(q.n, 0) + 1 AS DOUBLE) / CAST(2 * coalesce(t.n0, 0) + {_size} AS DOUBLE))))) AS ratio
  FROM steps s LEFT JOIN pairs p ON p.random = 1 AND p.x = s.x AND p.y = s.y LEFT JOIN pairs q ON q.random = 0 AND q.x = s.x AND q.y = s.y LEFT JOIN totals t ON t.x = s.x
  GROUP BY ALL
),
every AS (
  SELECT doc_id, rank, a, e FROM base
  UNION ALL SELECT doc_id, 3, a, e FROM scored WHERE ratio >= {LEAST_RATIO} AND ratio >= {LEAST_MEAN} * length(value)
),
told AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
         {_listed} FILTER (rank < 3) AS base, {_listed} AS spans
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""
