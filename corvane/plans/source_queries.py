"""Parsing of the sources and the batch form of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import parsing as P
from corvane.plans import base
from corvane.plans.registry import query
from corvane.streaming.incremental import changed_files, usage_by_window
from corvane.tables import load

_LG = base._EXT
_LANGUAGE = f"CASE WHEN {_LG} IN ('py', 'pyi') THEN 'python' WHEN {_LG} IN ('js', 'mjs') THEN 'javascript' WHEN {_LG} = 'ts' THEN 'typescript' WHEN {_LG} IN ('cpp', 'cc', 'hpp', 'h') THEN 'cpp' WHEN {_LG} = 'cs' THEN 'c_sharp' WHEN {_LG} = 'go' THEN 'go' END"
_LINE = f"""WITH {base.SQL}, l0 AS (SELECT file_id, {_LANGUAGE} AS language, string_split(regexp_replace(ltrim(text, chr(65279)), '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM r),
ln AS (SELECT file_id, language, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS code FROM l0 WHERE language IS NOT NULL)"""


def _case(patterns: dict[str, str]) -> str:
    return "nullif(CASE language " + " ".join(f"WHEN '{k}' THEN regexp_extract(code, '{v.replace(chr(39), chr(39) * 2)}', 1)" for k, v in patterns.items()) + " END, '')"


@query(
    "declared_names",
    _LINE
    + f""" SELECT file_id, CAST(line AS INT) AS line, CASE WHEN fn IS NOT NULL THEN 'function' ELSE 'class' END AS kind, coalesce(fn, kl) AS name
    FROM (SELECT file_id, line, coalesce({_case(P.FUNCTION)}, CASE WHEN {_case(P.METHOD)} NOT IN {P.NO_NAMES} THEN {_case(P.METHOD)} END) AS fn, {_case(P.CLASS)} AS kl FROM ln) WHERE coalesce(fn, kl) IS NOT NULL""",
)
def declared_names(spark, folder):
    """Functions and classes declared in the sources."""
    return P.declared_names(base.texts(spark, folder))


@query(
    "declarations",
    _LINE
    + f""", fl AS (SELECT file_id, language, line, replace(code, chr(9), '    ') AS code, length(regexp_extract(replace(code, chr(9), '    '), '^( *)', 1)) AS indent FROM ln WHERE trim(replace(code, chr(9), '    ')) <> ''),
    dc AS (SELECT file_id, line, indent, CASE WHEN fn IS NOT NULL THEN 'function' ELSE 'class' END AS kind, coalesce(fn, kl) AS name
      FROM (SELECT *, coalesce({_case(P.FUNCTION)}, CASE WHEN {_case(P.METHOD)} NOT IN {P.NO_NAMES} THEN {_case(P.METHOD)} END) AS fn, {_case(P.CLASS)} AS kl FROM fl) WHERE coalesce(fn, kl) IS NOT NULL),
    sp AS (SELECT dc.file_id, dc.line, dc.kind, dc.name, coalesce(min(fl.line), 1000000000) AS stop FROM dc LEFT JOIN fl ON fl.file_id = dc.file_id AND fl.line > dc.line
      AND (fl.indent < dc.indent OR fl.indent = dc.indent AND NOT regexp_matches(trim(fl.code), '^([)\\]}}{{]|(public|private|protected)\\s*:)')) GROUP BY ALL)
    SELECT sp.file_id, CAST(sp.line AS INT) AS line, CAST(max(fl.line) AS INT) AS end_line, kind, name FROM sp JOIN fl ON fl.file_id = sp.file_id AND fl.line >= sp.line AND fl.line < stop GROUP BY ALL""",
)
def declarations(spark, folder):
    """Functions and classes declared in the sources, with their spans."""
    return P.declarations(base.texts(spark, folder))


@query("import_edges", _LINE + f" SELECT DISTINCT file_id, coalesce({_case(P.IMPORT)}, {_case(P.IMPORT_ALONE)}) AS target FROM ln WHERE coalesce({_case(P.IMPORT)}, {_case(P.IMPORT_ALONE)}) IS NOT NULL")
def import_edges(spark, folder):
    """Modules that files import."""
    return P.import_edges(base.texts(spark, folder))


@query(
    "inherits_edges",
    _LINE + f" SELECT DISTINCT file_id, CAST(line AS INT) AS line, base FROM (SELECT file_id, line, trim(unnest(string_split({_case(P.BASES)}, ','))) AS base FROM ln WHERE {_case(P.BASES)} IS NOT NULL) WHERE base <> ''",
)
def inherits_edges(spark, folder):
    """Bases that classes name."""
    return P.inherits_edges(base.texts(spark, folder))


@query(
    "stream_usage_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS calls, round(sum(value), 4) AS ms FROM events GROUP BY 1, 2",
)
def stream_usage_windows(spark, folder):
    """Usage by hour, as the stream computes it, over the whole table at once."""
    return usage_by_window(load(spark, folder, "events")).withColumn("ms", F.round("ms", 4))


@query(
    "stream_changed_files",
    "SELECT DISTINCT r.file_id, sha256(text) AS content_hash FROM raw_files r WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.id = r.file_id AND f.content_hash = sha256(r.text))",
)
def stream_changed_files(spark, folder):
    """Files of a batch that differ from everything that the index holds under their id."""
    stored = load(spark, folder, "files").select(F.col("id").alias("file_id"), "content_hash").distinct()
    return changed_files(load(spark, folder, "raw_files"), stored).select("file_id", "content_hash")
