"""The tables that the queries read, with explicit schemas for empty stand-ins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column types of the index tables (DDL), for empty tables and for readers without files.
SCHEMAS = {
    "repositories": "id string, name string, root_path string, tracking_mode string, "
    "created_at string, updated_at string",
    "files": "id string, repo_id string, path string, language string, content_hash string, "
    "size_bytes bigint, last_indexed_at string, summary string, importance int, mtime double",
    "raw_files": "file_id string, repo_id string, path string, text string",
    "symbols": "id string, repo_id string, file_id string, symbol_type string, name string, "
    "qualified_name string, signature string, start_line int, end_line int, summary string, "
    "content_hash string, decl_ref string, signature_hash string, fingerprint string, "
    "indexed_at timestamp_ntz",
    "chunks": "id string, repo_id string, file_id string, symbol_id string, chunk_type string, "
    "language string, path string, start_line int, end_line int, content string, summary string, "
    "content_hash string, ref string, scope string, qualified_name string, parent string, "
    "tags string, is_complete_unit int, unit_kind string, parent_ref string, "
    "indexed_at timestamp_ntz",
    "tombstones": "kind string, key string, deleted_at timestamp_ntz",
    "chunk_limits": "chunk_type string, max_chars int, overlap_lines int, overlap_chars int",
    "context_budgets": "profile string, capacity_tokens int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "title string, created_at timestamp_ntz",
    "benchmark": "item_id bigint, kind string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "relationships": "id string, repo_id string, source_type string, source_id string, "
    "relationship_type string, target_type string, target_id string, target_name string, "
    "confidence double, file_id string, origin string, receiver string, evidence string, "
    "evidence_hash string, created_at string",
    "tool_calls": "id bigint, ts string, surface string, session_id string, repo_id string, "
    "tool string, repo string, question string, inputs_json string, req_tokens int, "
    "resp_tokens int, resp_chars int, resp_preview string, ms double, ok int, error string",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def key_of(column: str | Column) -> Column:
    """A key as it is compared: trimmed and in lower case, null where nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def latest(df: DataFrame, key: str | list[str], by: list[Column]) -> DataFrame:
    """One row for each key: the one that is largest by ``by``.

    ``max_by`` aggregates on the map side, so a key with very many rows is reduced before the
    shuffle; a window would move and sort all of them.
    """
    keys = [key] if isinstance(key, str) else key
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*by)).alias("__row"))
    return best.select(*[F.col("__row")[c].alias(c) for c in df.columns])
