"""Column expressions on repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of a file by its extension, for the languages that are checked.
CODE_EXTENSIONS = {
    "py": "python",
    "pyi": "python",
    "js": "javascript",
    "mjs": "javascript",
    "ts": "typescript",
    "cpp": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "h": "cpp",
    "cs": "c_sharp",
    "go": "go",
    "json": "json",
    "xml": "xml",
    "csproj": "xml",
    "props": "xml",
    "md": "markdown",
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension in lower case, without the dot; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1)), F.lit(""))


def mapped(values: dict[str, str], key: Column) -> Column:
    """Look a key up in a small literal map; null where it is missing."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def code_language(path: Column) -> Column:
    """Language of a path by its extension; null for others. Null paths give null."""
    return mapped(CODE_EXTENSIONS, extension(path))
