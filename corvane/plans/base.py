"""Clean views of the index tables that the queries start from, in Spark and as SQL.

A record that was written again has several rows; each view keeps the one written last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.paths import code_language
from corvane.session import without_and_with
from corvane.tables import key_of, load


def files(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "files").select("id", "repo_id", "path").distinct()


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file: the least of rows that differ."""
    row = F.struct("repo_id", "path", "text")
    return load(spark, folder, "raw_files").groupBy("file_id").agg(F.min(row).alias("r")).select("file_id", "r.*")


_SYMBOL = ("repo_id", "file_id", "symbol_type", "name", "qualified_name", "start_line", "end_line", "signature", "signature_hash", "content_hash", "fingerprint")
_CHUNK = (
    "repo_id", "file_id", "path", "language", "symbol_id", "chunk_type", "start_line", "end_line", "content", "ref", "tags", "qualified_name", "summary",
    "is_complete_unit", "unit_kind", "parent_ref",
)


def _last_written(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    at = F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    return table.groupBy("id").agg(F.max_by(F.struct(*columns), at).alias("r")).select("id", "r.*")


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    s = load(spark, folder, "symbols").withColumn("file_id", key_of("file_id")).withColumn("symbol_type", F.lower(F.trim("symbol_type")))
    return _last_written(s, _SYMBOL)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "chunks").withColumn("file_id", key_of("file_id")).withColumn("symbol_id", key_of("symbol_id")).withColumn("chunk_type", F.lower(F.trim("chunk_type")))
    return _last_written(c, _CHUNK)


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``id, path, content, summary`` of ``chunks``; only those that were written again are moved."""
    columns = ("path", "content", "summary")
    c = load(spark, folder, "chunks").select("id", *columns, "indexed_at")
    once, again = without_and_with(c, c.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "id")
    once = once.select("id", *columns)
    return once if again is None else once.unionByName(_last_written(again, columns))


_K = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"

_AT = "coalesce(indexed_at, TIMESTAMP '1970-01-01')"


def _fields(columns: tuple[str, ...]) -> str:
    form = {"file_id": _K.format(c="file_id"), "symbol_id": _K.format(c="symbol_id"), "symbol_type": "lower(trim(symbol_type))", "chunk_type": "lower(trim(chunk_type))"}
    return ", ".join(f"{c} := {form.get(c, c)}" for c in columns)


#: The same views as SQL, to stand behind WITH.
SQL = f"""
f AS (SELECT DISTINCT id, repo_id, path FROM files),
r AS (SELECT file_id, unnest(min(struct_pack(repo_id := repo_id, path := path, text := text))) FROM raw_files GROUP BY 1),
s AS (SELECT id, unnest(arg_max(struct_pack({_fields(_SYMBOL)}), {_AT})) FROM symbols GROUP BY 1),
c AS (SELECT id, unnest(arg_max(struct_pack({_fields(_CHUNK)}), {_AT})) FROM chunks GROUP BY 1)
"""


def graph_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols with the path and language of their file, those of known files only."""
    paths = files(spark, folder).select(key_of("id").alias("file_id"), "path", code_language(F.col("path")).alias("language"))
    return symbols(spark, folder).join(paths, "file_id")


_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
#: graph_symbols as SQL, after SQL.
GRAPH_SQL = f"""
gs AS (SELECT s.*, p.path, p.language FROM s
  JOIN (SELECT {_K.format(c='id')} AS file_id, path, CASE WHEN {_EXT} IN ('py', 'pyi') THEN 'python' WHEN {_EXT} IN ('js', 'mjs') THEN 'javascript' WHEN {_EXT} = 'ts' THEN 'typescript'
    WHEN {_EXT} IN ('cpp', 'cc', 'hpp', 'h') THEN 'cpp' WHEN {_EXT} = 'cs' THEN 'c_sharp' WHEN {_EXT} = 'go' THEN 'go' WHEN {_EXT} = 'json' THEN 'json'
    WHEN {_EXT} IN ('xml', 'csproj', 'props') THEN 'xml' WHEN {_EXT} = 'md' THEN 'markdown' END AS language FROM f) p ON p.file_id = s.file_id)
"""
