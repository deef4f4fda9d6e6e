"""Scan of a source tree, with ignore rules, and the sinks of the call log and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Folders and names that are never read, whatever the rules say.
HARD_DIRS = (".git", ".corvane", "secrets", "credentials")
HARD_GLOBS = (".env", ".env.*", "*.pem", "*.key", "*.pfx", "*.cer", "*.p12")
#: Rules that always hold, before those of the caller or of the tree.
DEFAULT_RULES = (
    ".venv/ venv/ env/ node_modules/ bin/ obj/ dist/ build/ target/ out/ .dart_tool/ .symlinks/ .plugin_symlinks/ .fvm/ ephemeral/ Pods/ Carthage/ "
    "__pycache__/ .pytest_cache/ .mypy_cache/ .ruff_cache/ *.egg-info/ .vs/ .idea/ .vscode/ .env .env.* *.pem *.key *.pfx *.cer *.p12 secrets/ credentials/ "
    "*.zip *.rar *.7z *.tar *.gz *.dll *.exe *.so *.dylib *.pyc *.pyd *.bin *.png *.jpg *.jpeg *.gif *.ico *.pdf"
).split()
#: Files at the root of a tree that hold rules; the first that is there counts.
RULE_FILES = (".corvaneignore", ".gitignore")


def rules_of(spark: SparkSession, root: str) -> list[str]:
    """The default rules and those of the tree's own rule file. Such files are hidden, so they are read
    through the file system instead of a scan; negated rules are passed over."""
    fs = spark._jvm.org.apache.hadoop.fs
    for name in RULE_FILES:
        path = fs.Path(root, name)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):
            stream = system.open(path)
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return [*DEFAULT_RULES, *text.splitlines()]
    return list(DEFAULT_RULES)


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression on a name."""
    out = ""
    for c in glob:
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in ".^$+{}[]|()\\" else c)
    return out


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a path is ignored: by a fixed folder or name, or by a rule (``dir/``, glob or plain name)."""
    parts = F.split(path, "/")
    hit = F.arrays_overlap(parts, F.array(*map(F.lit, HARD_DIRS)))
    base = F.substring_index(path, "/", -1)
    for g in HARD_GLOBS:
        hit = hit | base.rlike(f"^{glob_pattern(g)}$")
    for rule in (r.strip().lstrip("/") for r in rules):
        if not rule or rule.startswith(("#", "!")):
            continue
        if rule.endswith("/"):
            folder = rule.strip("/")
            plain = F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{folder}/")
            hit = hit | (F.exists(parts, lambda x: x.rlike(f"^{glob_pattern(folder)}$")) if any(c in folder for c in "*?") else plain)
        elif any(c in rule for c in "*?["):
            hit = hit | base.rlike(f"^{glob_pattern(rule)}$") | path.rlike(f"^{glob_pattern(rule)}$")
        else:
            hit = hit | F.array_contains(parts, rule)
    return hit


def scan(spark: SparkSession, root: str, rules: list[str] | None = None, max_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """The files of a tree and those that are too large: ``path, language, size, mtime, text,
    content_hash`` and ``path, size``.

    Without ``rules`` those of the tree's own rule file hold; the default ones always do. Unknown extensions, ignored paths and binary files are left out. Sizes and names are known
    before any content is read, so large files are not read at all.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), prefix, -1)
    named = raw.select(path.alias("path"), "length", "modificationTime", "content").where(T.index_language(F.col("path")).isNotNull() & ~ignored(F.col("path"), rules_of(spark, root) if rules is None else [*DEFAULT_RULES, *rules]))
    large = named.where(F.col("length") > max_bytes).select("path", F.col("length").alias("size"))
    small = named.where(F.col("length") <= max_bytes)
    binary = F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00")
    files = small.where(~binary).select(
        "path", T.index_language(F.col("path")).alias("language"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("content_hash"),
    )
    return files, large


def append_log(calls: DataFrame, folder: str) -> None:
    """Append calls to the log, one JSON object a line."""
    calls.write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The call log; lines that are no JSON are left out."""
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder).where("_bad IS NULL").drop("_bad")


def write_index(table: DataFrame, folder: str, partitions: str = "repo_id") -> None:
    """Write a table of the index, partitioned by repository, replacing the partitions that it holds."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partitions).parquet(folder)
