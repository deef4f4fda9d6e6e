"""Queries of problem 4: references to records that do not exist."""

from __future__ import annotations

from corvane.operators.orphans import INDEX_KEYS, orphan_report, orphans
from corvane.plans.registry import query
from corvane.tables import load

_KEY = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_MICROS_TEXT = (
    "epoch_us(try_cast(CASE WHEN regexp_matches(trim({c}), '(Z|z|[+-]\\d\\d:?\\d\\d)$') "
    "THEN trim({c}) ELSE trim({c}) || 'Z' END AS TIMESTAMPTZ))"
)


def _k(c: str) -> str:
    return _KEY.format(c=c)


#: Common table expressions: direct orphans (d) and chunks below orphaned symbols (i).
_CTES = f"""
WITH stones AS (
  SELECT lower(trim(kind)) AS kind, {_k('key')} AS key, max(epoch_us(deleted_at)) AS gone
  FROM tombstones WHERE {_k('key')} IS NOT NULL GROUP BY 1, 2),
tf AS (
  SELECT {_k('id')} AS key, min({_MICROS_TEXT.format(c='last_indexed_at')}) AS first_at,
         max({_MICROS_TEXT.format(c='last_indexed_at')}) AS last_at FROM files GROUP BY 1),
ts AS (
  SELECT {_k('id')} AS key, min(epoch_us(indexed_at)) AS first_at, max(epoch_us(indexed_at)) AS last_at
  FROM symbols GROUP BY 1),
refs AS (
  SELECT 'symbols' AS ref_table, 'file_id' AS ref_column, 'file' AS kind, id AS row_id, {_k('file_id')} AS key,
         epoch_us(indexed_at) AS wrote FROM symbols
  UNION ALL
  SELECT 'chunks', 'symbol_id', 'symbol', id, {_k('symbol_id')}, epoch_us(indexed_at) FROM chunks),
targets AS (
  SELECT 'file' AS kind, * FROM tf UNION ALL SELECT 'symbol', * FROM ts),
judged AS (
  SELECT r.*, CASE WHEN t.key IS NULL THEN 'missing'
                   WHEN s.gone IS NOT NULL AND (t.last_at IS NULL OR t.last_at < s.gone) THEN 'deleted'
                   WHEN t.first_at > r.wrote THEN 'late' END AS reason
  FROM refs r LEFT JOIN targets t ON t.kind = r.kind AND t.key = r.key
  LEFT JOIN stones s ON s.kind = r.kind AND s.key = r.key
  WHERE r.key IS NOT NULL AND r.row_id IS NOT NULL),
d AS (
  SELECT ref_table, ref_column, row_id,
         min((strftime(make_timestamp(wrote), '%Y-%m'), reason)) AS v
  FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3),
i AS (
  SELECT r.ref_table, r.ref_column, r.row_id,
         min((strftime(make_timestamp(r.wrote), '%Y-%m'), 'parent is an orphan')) AS v
  FROM refs r WHERE r.ref_table = 'chunks' AND r.row_id IS NOT NULL
    AND r.key IN (SELECT {_k('row_id')} FROM d WHERE ref_table = 'symbols')
    AND r.row_id NOT IN (SELECT row_id FROM d WHERE ref_table = 'chunks')
  GROUP BY 1, 2, 3),
everything AS (
  SELECT ref_table, ref_column, row_id, v[1] AS period, 'direct' AS kind, v[2] AS reason, 0 AS hops FROM d
  UNION ALL
  SELECT ref_table, ref_column, row_id, v[1], 'inherited', v[2], 1 FROM i)
"""


def _cascade(spark, folder):
    tables = {name: load(spark, folder, name) for name in ("files", "symbols", "chunks")}
    return orphans(tables, INDEX_KEYS, load(spark, folder, "tombstones"))


@query("p4_found", _CTES + "SELECT ref_table, ref_column, row_id FROM everything WHERE kind = 'direct'")
def p4_found(spark, folder):
    """The records at which the cascade begins: those that are orphans themselves, each once."""
    return _cascade(spark, folder).where("kind = 'direct'").select("ref_table", "ref_column", "row_id")


@query("p4_cascade", _CTES + "SELECT * FROM everything")
def p4_cascade(spark, folder):
    """Direct and inherited orphans with their reason and month."""
    return _cascade(spark, folder)


@query(
    "p4_report",
    _CTES
    + "SELECT ref_table, ref_column, period, kind, reason, count(*) AS n_rows FROM everything GROUP BY ALL",
)
def p4_report(spark, folder):
    """Counts of orphan references by referring table and month."""
    return orphan_report(_cascade(spark, folder))
