"""Change tracking: snapshots, upserts, cascading deletes, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.orphans import micros
from corvane.tables import key_of, latest


def last_wins(files: DataFrame) -> DataFrame:
    """One row for each file: the one indexed last, with the number of rows it had."""
    stamped = files.select("id", "path", "last_indexed_at", micros(files, "last_indexed_at").alias("at"))
    return stamped.groupBy("id", "path").agg(F.max_by("last_indexed_at", F.struct("at", "last_indexed_at")).alias("last_indexed_at"), F.count(F.lit(1)).alias("n_rows"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` with the rows of ``new`` put in place of those of the same key; the last of ``new`` wins."""
    new = latest(new.withColumn("__seq", F.monotonically_increasing_id()), key, [F.col("__seq")]).drop("__seq")
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def diff(stored: DataFrame, live: DataFrame) -> DataFrame:
    """``path, state`` of each file: new, changed, unchanged or deleted, by id and content hash."""
    o, n = stored.alias("o"), live.alias("n")
    state = (
        F.when(F.col("o.id").isNull(), "new").when(F.col("n.id").isNull(), "deleted").when(F.col("o.content_hash") != F.col("n.content_hash"), "changed").otherwise("unchanged")
    )
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(F.coalesce("o.path", "n.path").alias("path"), state.alias("state"))


def cascade_delete(symbols: DataFrame, chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """How many symbols and chunks are left once deleted files and symbols take theirs along.

    A symbol goes with its file or by its own tombstone, a chunk with its file or its symbol,
    whichever way that symbol went.
    """
    gone = tombstones.select("kind", key_of("key").alias("key")).where("key IS NOT NULL").distinct()
    gone_files = gone.where("kind = 'file'").select(F.col("key").alias("file_id"))
    named = gone.where("kind = 'symbol'").select(F.col("key").alias("symbol_id"))
    keyed = symbols.select(key_of("id").alias("symbol_id"), key_of("file_id").alias("file_id"))
    gone_symbols = named.unionByName(keyed.join(gone_files, "file_id", "left_semi").select("symbol_id")).distinct()
    left_s = keyed.join(gone_files, "file_id", "left_anti").join(named, "symbol_id", "left_anti")
    left_c = (
        chunks.select(key_of("file_id").alias("file_id"), key_of("symbol_id").alias("symbol_id"))
        .join(gone_files, "file_id", "left_anti")
        .join(gone_symbols, "symbol_id", "left_anti")
    )
    return left_s.agg(F.count(F.lit(1)).alias("n_kept")).select(F.lit("symbols").alias("table_name"), "n_kept").unionByName(
        left_c.agg(F.count(F.lit(1)).alias("n_kept")).select(F.lit("chunks").alias("table_name"), "n_kept")
    )


def staleness(refs: DataFrame, stored: DataFrame, live: DataFrame) -> DataFrame:
    """``refs`` with ``state``: missing, not_indexed, current or changed, by the hash of their file, which
    repository and path name."""
    joined = refs.join(stored, ["repo_id", "path"], "left").join(live, ["repo_id", "path"], "left")
    state = (
        F.when(F.col("live_hash").isNull(), "missing").when(F.col("content_hash").isNull(), "not_indexed").when(F.col("content_hash") == F.col("live_hash"), "current").otherwise("changed")
    )
    return joined.withColumn("state", state)


def fates(before: DataFrame, live: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """What became of symbols of files that changed: ``symbol_id, repo_id, path, name, fate, now``.

    ``before`` are the symbols as indexed, ``live`` those of today, both with ``id, repo_id, path,
    qualified_name, name, signature_hash, fingerprint``; ``changed`` and ``deleted`` have ``repo_id,
    path``. The fate is ``removed`` if its file has no symbol of its name, ``renamed`` (``now`` is the
    new name) if just one symbol of the file has its body instead, ``signature_changed`` if none of its
    name has its signature, and ``file_deleted``. Symbols that are as they were are left out, and so
    are those of files that neither list names.
    """
    dotted = F.replace(F.coalesce("qualified_name", "name"), F.lit("::"), F.lit("."))
    old = before.select(F.col("id").alias("symbol_id"), "repo_id", "path", "name", dotted.alias("q"), "signature_hash", "fingerprint")
    gone = old.join(deleted.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi").select("symbol_id", "repo_id", "path", "name", F.lit("file_deleted").alias("fate"), F.lit(None).cast("string").alias("now"))
    old = old.join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi").join(deleted.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")
    new = live.select("repo_id", "path", dotted.alias("q"), F.col("signature_hash").alias("sh"), F.col("fingerprint").alias("fp"))
    names = new.groupBy("repo_id", "path", "q").agg(F.collect_set("sh").alias("signatures"), F.lit(True).alias("there"))
    bodies = new.where("fp IS NOT NULL").groupBy("repo_id", "path", F.col("fp").alias("fingerprint")).agg(F.count(F.lit(1)).alias("k"), F.min("q").alias("moved")).where("k = 1")
    j = old.join(names, ["repo_id", "path", "q"], "left").join(bodies, ["repo_id", "path", "fingerprint"], "left")
    fate = (
        F.when(F.col("there").isNull() & F.col("moved").isNotNull(), "renamed")
        .when(F.col("there").isNull(), "removed")
        .when(F.col("signature_hash").isNotNull() & ~F.array_contains("signatures", F.col("signature_hash")), "signature_changed")
    )
    found = j.select("symbol_id", "repo_id", "path", "name", fate.alias("fate"), F.when(fate == "renamed", F.col("moved")).alias("now")).where("fate IS NOT NULL")
    return found.unionByName(gone)


def broken_calls(found: DataFrame, callers: DataFrame) -> DataFrame:
    """Fates with how many callers they leave: ``n_confident, n_possible``; those without callers are
    left out, as nothing breaks."""
    by = callers.groupBy(F.col("target_id").alias("symbol_id")).agg(F.count_if(F.col("tier") == "confident").alias("n_confident"), F.count_if(F.col("tier") == "possible").alias("n_possible"))
    return found.join(by, "symbol_id")


def dangling_imports(found: DataFrame, deleted: DataFrame, imports: DataFrame) -> DataFrame:
    """``repo_id, importer_path, name, why`` of imports of what is no longer there, each once.

    ``imports`` has ``repo_id, path, name``: the last part of a module, or a name imported from it.
    A deleted file dangles under its stem, its symbols and removed or renamed ones under their names.
    """
    stem = F.regexp_extract(F.substring_index("path", "/", -1), r"^(.*?)(?:\.[^.]*)?$", 1)
    names = deleted.select("repo_id", stem.alias("name"), F.lit(1).alias("w")).unionByName(
        found.where("fate IN ('file_deleted', 'removed', 'renamed')").select("repo_id", "name", F.when(F.col("fate") == "file_deleted", 2).otherwise(3).alias("w"))
    )
    first = names.groupBy("repo_id", "name").agg(F.min("w").alias("w"))
    why = F.when(F.col("w") == 1, "module or file deleted").when(F.col("w") == 2, "file of the symbol deleted").otherwise("symbol removed or renamed")
    return imports.join(first, ["repo_id", "name"]).select("repo_id", F.col("path").alias("importer_path"), "name", why.alias("why")).distinct()
