"""Aggregations over the index and over the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


def repo_counts(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, symbols and chunks of each repository, counted in one shuffle."""
    def part(df: DataFrame, *n: int) -> DataFrame:
        return df.select("repo_id", *[F.lit(x).alias(c) for x, c in zip(n, ("f", "s", "c"))])

    rows = part(files, 1, 0, 0).unionByName(part(symbols, 0, 1, 0)).unionByName(part(chunks, 0, 0, 1))
    return rows.groupBy("repo_id").agg(
        F.sum("f").cast("bigint").alias("n_files"), F.sum("s").cast("bigint").alias("n_symbols"), F.sum("c").cast("bigint").alias("n_chunks")
    )


def map_default(files: DataFrame, folders: int = 20, important: int = 15, entries: int = 10) -> DataFrame:
    """Languages, largest folders, important files and entry files as rows of ``section, name, n``."""
    path = F.col("path")
    languages = files.groupBy(F.coalesce(T.index_language(path), F.lit("?")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    tops = files.groupBy(T.top_folder(path).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(folders)
    paths = files.select("path").distinct()

    def listed(which, limit: int) -> DataFrame:
        return paths.where(which).orderBy("path").limit(limit).select(F.col("path").alias("name"), F.lit(1).cast("bigint").alias("n"))

    parts = {"language": languages, "folder": tops, "important": listed(T.is_important(path), important), "entry": listed(T.looks_entry(path), entries)}
    out = None
    for section, rows in parts.items():
        rows = rows.select(F.lit(section).alias("section"), "name", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def map_architecture(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.groupBy(T.top_folder(path).alias("folder"), F.coalesce(T.index_language(path), F.lit("?")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


def map_domains(chunks: DataFrame, limit: int = 25) -> DataFrame:
    """The folders that occur oftenest in the paths of cards."""
    return chunks.select(F.explode(T.domains_of(F.col("path"))).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(limit)


def map_entrypoints(chunks: DataFrame) -> DataFrame:
    kinds = chunks.select("ref", F.explode(T.hinted(F.col("content"), T.ENTRYPOINTS)).alias("kind"))
    return kinds.groupBy("kind").agg(F.countDistinct("ref").alias("n_refs"), F.min("ref").alias("first_ref"))


def map_tests(files: DataFrame) -> DataFrame:
    tests = files.where(T.is_test_path(F.col("path")))
    return tests.groupBy(F.coalesce(T.index_language(F.col("path")), F.lit("?")).alias("language")).agg(F.count(F.lit(1)).alias("n_tests"))


def skeleton_modules(files: DataFrame, chunks: DataFrame, limit: int = 15) -> DataFrame:
    """The largest modules with their role: tests if all files are, else the commonest domain."""
    path = F.col("path")
    modules = files.groupBy(T.module_key(path).alias("module")).agg(
        F.count(F.lit(1)).alias("n_files"), F.bool_and(T.is_test_path(path)).alias("all_tests"), F.min(T.index_language(path)).alias("language")
    )
    largest = modules.orderBy(F.desc("n_files"), "module").limit(limit)
    domains = (
        chunks.select(T.module_key(path).alias("module"), F.explode(T.domains_of(path)).alias("domain"))
        .groupBy("module", "domain")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("module")
        .agg(F.min_by("domain", F.struct(-F.col("n"), F.col("domain"))).alias("domain"))
    )
    role = F.when(F.col("all_tests"), "tests").when(F.col("domain").isNotNull(), F.col("domain")).otherwise(F.concat(F.coalesce("language", F.lit("?")), F.lit(" module")))
    return largest.join(domains, "module", "left").select("module", "n_files", role.alias("role"))


def _rounded(c):
    return F.floor(c * 10 + 0.5) / 10


def usage_stats(calls: DataFrame) -> DataFrame:
    """Calls, errors and latencies by tool; calls without latency count as calls only."""
    return calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("errors"),
        _rounded(F.avg("ms")).alias("ms_avg"),
        _rounded(F.percentile("ms", F.lit(0.5))).alias("ms_p50"),
        _rounded(F.percentile("ms", F.lit(0.95))).alias("ms_p95"),
    )


def usage_summary(calls: DataFrame) -> DataFrame:
    stamp = "yyyy-MM-dd HH:mm:ss"
    return calls.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.countDistinct("session_id").alias("sessions"),
        F.date_format(F.min("ts"), stamp).alias("first_ts"),
        F.date_format(F.max("ts"), stamp).alias("last_ts"),
    )


def log_tail(calls: DataFrame, tool: str | None = None, session_id=None, since: str | None = None, limit: int = 20) -> DataFrame:
    """The last calls that pass the given filters."""
    if tool is not None:
        calls = calls.where(F.col("tool") == tool)
    if session_id is not None:
        calls = calls.where(F.col("session_id") == session_id)
    if since is not None:
        calls = calls.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return calls.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
