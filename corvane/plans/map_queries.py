"""Maps, counts, usage of the call log and change tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import aggregates as A
from corvane.operators import changes as C
from corvane.plans import base
from corvane.plans.registry import query
from corvane.plans.text_queries import _BASE, _LANG, _W
from corvane.tables import key_of, load

_L = _LANG.replace("{p}", "path")
_FOLDER = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END"
_MODULE = "CASE len(string_split(path, '/')) WHEN 1 THEN '(root)' WHEN 2 THEN split_part(path, '/', 1) ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END"
_TEST = f"(regexp_matches(lower(path), '^tests?/|/tests?/') OR starts_with(lower({_BASE}), 'conftest') OR len(list_intersect(list_transform(regexp_extract_all(regexp_replace(regexp_replace({_BASE}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+|[0-9]+'), lambda x: lower(x)), ['test', 'tests', 'spec'])) > 0)"


@query(
    "repo_counts",
    _W
    + """SELECT repo_id, CAST(sum(nf) AS BIGINT) AS n_files, CAST(sum(ns) AS BIGINT) AS n_symbols, CAST(sum(nc) AS BIGINT) AS n_chunks FROM (
      SELECT repo_id, 1 AS nf, 0 AS ns, 0 AS nc FROM f UNION ALL SELECT repo_id, 0, 1, 0 FROM s UNION ALL SELECT repo_id, 0, 0, 1 FROM c) GROUP BY 1""",
)
def repo_counts(spark, folder):
    return A.repo_counts(base.files(spark, folder), base.symbols(spark, folder), base.chunks(spark, folder))


@query(
    "map_default",
    _W
    + f"""SELECT * FROM (SELECT 'language' AS section, coalesce({_L}, '?') AS name, count(*) AS n FROM f GROUP BY 1, 2
      UNION ALL (SELECT 'folder', {_FOLDER} AS name, count(*) AS n FROM f GROUP BY 1, 2 ORDER BY n DESC, name LIMIT 20)
      UNION ALL (SELECT 'important', path, 1 FROM (SELECT DISTINCT path FROM f) WHERE {' OR '.join(f"contains(lower({_BASE}), '{x}')" for x in T.IMPORTANT)} ORDER BY path LIMIT 15)
      UNION ALL (SELECT 'entry', path, 1 FROM (SELECT DISTINCT path FROM f) WHERE {' OR '.join(f"contains(lower(path), '{x}')" for x in T.ENTRY_FILES)} ORDER BY path LIMIT 10))""",
)
def map_default(spark, folder):
    return A.map_default(base.files(spark, folder))


@query(
    "map_architecture",
    _W + f"SELECT {_FOLDER} AS folder, coalesce({_L}, '?') AS language, count(*) AS n_files FROM f GROUP BY 1, 2",
)
def map_architecture(spark, folder):
    return A.map_architecture(base.files(spark, folder))


@query(
    "map_domains",
    _W + "SELECT domain, count(*) AS n FROM (SELECT unnest(list_filter(string_split(path, '/')[:-2], lambda x: x <> '')[-4:]) AS domain FROM c) GROUP BY 1 ORDER BY n DESC, domain LIMIT 25",
)
def map_domains(spark, folder):
    return A.map_domains(base.chunks(spark, folder))


def _entry_sql() -> str:
    from corvane.plans.text_queries import _hints

    return _W + f"SELECT kind, count(DISTINCT ref) AS n_refs, min(ref) AS first_ref FROM (SELECT ref, unnest({_hints('content', T.ENTRYPOINTS)}) AS kind FROM c) GROUP BY 1"


@query("map_entrypoints", _entry_sql())
def map_entrypoints(spark, folder):
    return A.map_entrypoints(base.chunks(spark, folder))


@query("map_tests", _W + f"SELECT coalesce({_L}, '?') AS language, count(*) AS n_tests FROM f WHERE {_TEST} GROUP BY 1")
def map_tests(spark, folder):
    return A.map_tests(base.files(spark, folder))


@query(
    "skeleton_modules",
    _W
    + f"""SELECT module, n_files, role FROM (
      SELECT m.module, m.n_files, CASE WHEN m.all_tests THEN 'tests' WHEN d.domain IS NOT NULL THEN d.domain ELSE coalesce(m.language, '?') || ' module' END AS role
      FROM (SELECT {_MODULE} AS module, count(*) AS n_files, bool_and({_TEST}) AS all_tests, min({_L}) AS language FROM f GROUP BY 1) m
      LEFT JOIN (SELECT module, domain FROM (SELECT module, domain, row_number() OVER (PARTITION BY module ORDER BY n DESC, domain) AS rn FROM (
        SELECT module, domain, count(*) AS n FROM (SELECT {_MODULE} AS module, unnest(list_filter(string_split(path, '/')[:-2], lambda x: x <> '')[-4:]) AS domain FROM c) GROUP BY 1, 2)) WHERE rn = 1) d
      ON d.module = m.module) ORDER BY n_files DESC, module LIMIT 15""",
)
def skeleton_modules(spark, folder):
    return A.skeleton_modules(base.files(spark, folder), base.chunks(spark, folder))


@query("diagnostics", _W + "SELECT coalesce(chunk_type, '?') AS chunk_type, coalesce(language, '?') AS language, count(*) AS n FROM c GROUP BY 1, 2")
def diagnostics(spark, folder):
    c = base.chunks(spark, folder)
    return c.groupBy(F.coalesce("chunk_type", F.lit("?")).alias("chunk_type"), F.coalesce("language", F.lit("?")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "usage_stats",
    """SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, floor(avg(value) * 10 + 0.5) / 10 AS ms_avg,
       floor(quantile_cont(value, 0.5) * 10 + 0.5) / 10 AS ms_p50, floor(quantile_cont(value, 0.95) * 10 + 0.5) / 10 AS ms_p95 FROM events GROUP BY 1""",
)
def usage_stats(spark, folder):
    return A.usage_stats(_calls(spark, folder))


@query(
    "usage_summary",
    """SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS sessions, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events""",
)
def usage_summary(spark, folder):
    return A.usage_summary(_calls(spark, folder))


def _calls(spark, folder):
    """The events as a call log."""
    e = load(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("tool"), F.col("user_id").alias("session_id"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok")
    )


@query("log_tail", "SELECT event_id AS id, event_type AS tool, value AS ms FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def log_tail(spark, folder):
    return A.log_tail(_calls(spark, folder), tool="error", limit=20).select("id", "tool", "ms")


@query(
    "files_last_wins",
    """SELECT id, path, arg_max(last_indexed_at, (epoch_us(try_cast(CASE WHEN regexp_matches(last_indexed_at, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN last_indexed_at ELSE last_indexed_at || 'Z' END AS TIMESTAMPTZ)), last_indexed_at)) AS last_indexed_at,
       count(*) AS n_rows FROM files GROUP BY id, path""",
)
def files_last_wins(spark, folder):
    return C.last_wins(load(spark, folder, "files"))


@query(
    "diff_snapshot",
    """SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'unchanged' END AS state
       FROM (SELECT DISTINCT id, path, content_hash FROM files) o
       FULL JOIN (SELECT DISTINCT file_id, path, sha256(text) AS content_hash FROM raw_files) n ON n.file_id = o.id""",
)
def diff_snapshot(spark, folder):
    stored = load(spark, folder, "files").select("id", "path", "content_hash").distinct()
    live = load(spark, folder, "raw_files").select(F.col("file_id").alias("id"), "path", F.sha2("text", 256).alias("content_hash")).distinct()
    return C.diff(stored, live)


@query(
    "cascade_delete",
    _W
    + """, ts AS (SELECT DISTINCT kind, lower(trim(key)) AS key FROM tombstones WHERE trim(key) <> ''),
      df AS (SELECT key FROM ts WHERE kind = 'file'), ds AS (SELECT key FROM ts WHERE kind = 'symbol' UNION SELECT lower(trim(id)) FROM s WHERE file_id IN (SELECT key FROM df))
      SELECT 'symbols' AS table_name, count(*) AS n_kept FROM s WHERE lower(trim(id)) NOT IN (SELECT key FROM ds)
      UNION ALL SELECT 'chunks', count(*) FROM c WHERE coalesce(file_id NOT IN (SELECT key FROM df), true) AND coalesce(symbol_id NOT IN (SELECT key FROM ds), true)""",
)
def cascade_delete(spark, folder):
    """Symbols and chunks that are left once deleted files and symbols took theirs along."""
    return C.cascade_delete(base.symbols(spark, folder), base.chunks(spark, folder), load(spark, folder, "tombstones"))


@query(
    "staleness",
    _W
    + """SELECT state, count(*) AS n FROM (SELECT c.id, CASE WHEN r.hash IS NULL THEN 'missing' WHEN f.content_hash IS NULL THEN 'not_indexed' WHEN f.content_hash = r.hash THEN 'current' ELSE 'changed' END AS state
      FROM c LEFT JOIN (SELECT repo_id, path, max((coalesce(last_indexed_at, ''), content_hash))[2] AS content_hash FROM files WHERE content_hash IS NOT NULL GROUP BY 1, 2) f ON f.repo_id = c.repo_id AND f.path = c.path
      LEFT JOIN (SELECT repo_id, path, min(sha256(text)) AS hash FROM r GROUP BY 1, 2) r ON r.repo_id = c.repo_id AND r.path = c.path) GROUP BY 1""",
)
def staleness(spark, folder):
    """Cards by whether their file, named by repository and path, is as it was indexed last."""
    stored = load(spark, folder, "files").where("content_hash IS NOT NULL").groupBy("repo_id", "path").agg(F.max(F.struct(F.coalesce("last_indexed_at", F.lit("")), "content_hash")).alias("m"))
    stored = stored.select("repo_id", "path", F.col("m.content_hash").alias("content_hash"))
    live = base.texts(spark, folder).groupBy("repo_id", "path").agg(F.min(F.sha2("text", 256)).alias("live_hash"))
    return C.staleness(base.chunks(spark, folder), stored, live).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "session_ledger",
    """SELECT user_id AS session_id, count(DISTINCT event_type || props) AS n_facts, count(*) AS n_calls, arg_min(event_type, (ts, event_id)) AS first_tool FROM events GROUP BY 1""",
)
def session_ledger(spark, folder):
    """Distinct facts of each session in the order in which they were first seen."""
    e = load(spark, folder, "events")
    return e.groupBy(F.col("user_id").alias("session_id")).agg(
        F.countDistinct(F.concat("event_type", "props")).alias("n_facts"),
        F.count(F.lit(1)).alias("n_calls"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_tool"),
    )


@query(
    "session_windows",
    """SELECT user_id, count(*) AS n_sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, k, count(*) AS n FROM (
       SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
       SELECT user_id, ts, event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1""",
)
def session_windows(spark, folder):
    """Sessions of a user: events less than four hours apart (an extension)."""
    e = load(spark, folder, "events")
    sessions = e.groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


@query(
    "usage_cube",
    "SELECT event_type AS tool, CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY CUBE (event_type, CAST(ts AS DATE))",
)
def usage_cube(spark, folder):
    """Calls by tool and day with all subtotals (an extension)."""
    e = load(spark, folder, "events")
    return e.select(F.col("event_type").alias("tool"), F.to_date("ts").alias("day")).cube("tool", "day").agg(F.count(F.lit(1)).alias("calls"))


@query("usage_sketches")
def usage_sketches(spark, folder):
    """Approximate distinct sessions and percentiles by tool (an extension)."""
    e = load(spark, folder, "events")
    return e.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("sessions"), F.percentile_approx("value", 0.95, 1000).alias("ms_p95"))


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue, count(*) AS n
       FROM lineitem GROUP BY 1, 2""",
)
def pricing_summary(spark, folder):
    """A plain grouped aggregate over the widest table, as a baseline of throughput."""
    item = load(spark, folder, "lineitem")
    return item.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).cast("double").alias("revenue"),
        F.count(F.lit(1)).alias("n"),
    )
