"""Declarations, imports and bases read from source text, line by line in the JVM.

Each line is a row and each language one expression. What needs more than a line (spans, nesting)
is found in one pass over a file's lines with a stack: a declaration ends before the next line of
the same or less indentation. Exact for Python, C# and Go as they are
usually formatted, an approximation for other brace languages. HTML ids and CSS rules likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.paths import code_language
from corvane.session import ship_package

#: How functions, classes, imports and bases are written, by language; group 1 is the name.
FUNCTION = {
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*[<(]",
    "c_sharp": r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|partial)\s+)+[\w<>\[\],.?]+\s+(\w+)\s*\(",
}
METHOD = {
    "javascript": r"^\s+(?:(?:static|async|get|set)\s+)*(\w+)\s*\([^)]*\)\s*\{\s*$",
    "typescript": r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(\w+)\s*\([^)]*\)\s*(?::[^{]*)?\{\s*$",
    "cpp": r"^\s*(?:[\w:<>,*&]+\s+)+[*&]*([\w:~]+)\s*\([^;{]*\)\s*(?:const\s*)?(?:override\s*)?\{\s*$",
}
#: Words that look like a method's name before a bracket.
NO_NAMES = ("if", "for", "while", "switch", "catch", "return", "function", "else", "with", "do")
CLASS = {
    "python": r"^\s*class\s+(\w+)",
    "go": r"^type\s+(\w+)\s+(?:struct|interface)\b",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)",
    "c_sharp": r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial)\s+)*(?:class|interface|struct|enum)\s+(\w+)",
    "cpp": r"^\s*(?:class|struct)\s+(\w+)\s*[:{]?",
}
IMPORT = {
    "python": r"^\s*from\s+([\w.]+)\s+import\b",
    "javascript": r"^\s*import\b.*from\s+['\"]([^'\"]+)['\"]",
    "typescript": r"^\s*import\b.*from\s+['\"]([^'\"]+)['\"]",
    "c_sharp": r"^\s*using\s+([\w.]+)\s*;",
    "cpp": r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]",
}
#: The other form of an import, where a language has one.
IMPORT_ALONE = {
    "python": r"^\s*import\s+([\w.]+)",
    "javascript": r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)",
    "typescript": r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)",
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$",
}
BASES = {
    "python": r"^\s*class\s+\w+\s*\(([^)]*)\)",
    "typescript": r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+\w+\s+(?:extends|implements)\s+([\w.]+)",
    "javascript": r"^\s*(?:export\s+)?class\s+\w+\s+extends\s+([\w.]+)",
    "c_sharp": r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial)\s+)*class\s+\w+\s*:\s*([\w<>, .]+)",
    "cpp": r"^\s*(?:class|struct)\s+\w+\s*:\s*(?:public|private|protected)?\s*(\w+)",
}

def source_lines(files: DataFrame) -> DataFrame:
    """``file_id, path, language, line, code`` for every line of the code files."""
    named = files.select("file_id", "path", code_language(F.col("path")).alias("language"), "text").where(F.col("language").isin(*CLASS))
    plain = F.regexp_replace(F.regexp_replace("text", r"^\x{FEFF}", ""), r"\r\n?", "\n")
    return named.select("file_id", "path", "language", F.posexplode(F.split(plain, "\n")).alias("p", "code")).select("file_id", "path", "language", (F.col("p") + 1).alias("line"), "code")


def by_language(code: Column, patterns: dict[str, str], language: Column) -> Column:
    """Group 1 of the language's expression on a line; null where it does not match."""
    out = F.lit(None).cast("string") if not patterns else None
    for name, pattern in patterns.items():
        hit = F.regexp_extract(code, pattern, 1)
        out = F.when(language == name, hit) if out is None else out.when(language == name, hit)
    return F.nullif(out, F.lit(""))


def function_name(code: Column, language: Column) -> Column:
    """The name of the function or method that begins on a line."""
    method = by_language(code, METHOD, language)
    return F.coalesce(by_language(code, FUNCTION, language), F.when(~method.isin(*NO_NAMES), method))


def _span_ends(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For each line of a file the last one of its span, by a stack of open lines: a line that is
    indented less, or as little without closing anything, ends what was opened before it."""
    for indents, closings in batches:
        out = []
        for indent, closing in zip(indents, closings):
            ends, stack, last = [0] * len(indent), [], 0
            for k, (depth, closes) in enumerate(zip(indent, closing)):
                if depth < 0:  # blank
                    continue
                while stack and (depth < indent[stack[-1]] or depth == indent[stack[-1]] and not closes):
                    ends[stack.pop()] = last
                last = k + 1
                stack.append(k)
            for k in stack:
                ends[k] = last
            out.append(ends)
        yield pd.Series(out)


def declarations(files: DataFrame) -> DataFrame:
    """``file_id, line, end_line, kind, name`` of functions and classes. A span ends before the next
    filled line that is indented as little; closing brackets belong to it. Any depth is told apart."""
    ship_package(files.sparkSession)
    named = files.where("text IS NOT NULL").select("file_id", code_language(F.col("path")).alias("language"), "text").where(F.col("language").isin(*CLASS))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"^\x{FEFF}", ""), r"\r\n?", "\n"), r"\t", "    ")
    lines = named.select("file_id", "language", F.split(plain, "\n").alias("lines"))
    indent = F.transform("lines", lambda x: F.when(F.trim(x) == "", -1).otherwise(F.length(F.regexp_extract(x, r"^( *)", 1))))
    closing = F.transform("lines", lambda x: F.trim(x).rlike(r"^([)\]}{]|(public|private|protected)\s*:)"))
    ends = F.pandas_udf(_span_ends, "array<int>")(indent, closing)
    each = lines.select("file_id", "language", F.posexplode(F.arrays_zip("lines", ends.alias("ends"))).alias("p", "x"))
    code = each.select("file_id", "language", (F.col("p") + 1).alias("line"), F.col("x.ends").alias("end_line"), F.col("x.lines").alias("code"))
    function, klass = function_name(F.col("code"), F.col("language")), by_language(F.col("code"), CLASS, F.col("language"))
    kind = F.when(function.isNotNull(), "function").when(klass.isNotNull(), "class")
    return code.select("file_id", "line", "end_line", kind.alias("kind"), F.coalesce(function, klass).alias("name")).where("name IS NOT NULL AND end_line > 0")


def declared_names(files: DataFrame) -> DataFrame:
    """``file_id, line, kind, name`` of functions and classes, without their spans."""
    lines = source_lines(files)
    function, klass = function_name(F.col("code"), F.col("language")), by_language(F.col("code"), CLASS, F.col("language"))
    return lines.select("file_id", "line", F.when(function.isNotNull(), "function").otherwise("class").alias("kind"), F.coalesce(function, klass).alias("name")).where("name IS NOT NULL")


def import_edges(files: DataFrame) -> DataFrame:
    """``file_id, target`` of each module that a file imports, each once."""
    lines = source_lines(files)
    return lines.select("file_id", F.coalesce(by_language(F.col("code"), IMPORT, F.col("language")), by_language(F.col("code"), IMPORT_ALONE, F.col("language"))).alias("target")).where("target IS NOT NULL").distinct()


def inherits_edges(files: DataFrame) -> DataFrame:
    """``file_id, line, base`` of each base that a class names."""
    lines = source_lines(files)
    named = lines.select("file_id", "line", by_language(F.col("code"), BASES, F.col("language")).alias("bases")).where("bases IS NOT NULL")
    each = named.select("file_id", "line", F.explode(F.split("bases", ",")).alias("base"))
    return each.select("file_id", "line", F.trim("base").alias("base")).where("base != ''").distinct()


def html_elements(pages: DataFrame) -> DataFrame:
    """``id, line, name, signature`` of each element with an id in ``pages(id, html)``."""
    lines = pages.select("id", F.posexplode(F.split("html", "\n")).alias("p", "code"))
    tags = F.regexp_extract_all("code", F.lit(r"(?i)(<[a-z][\w-]*\b[^<>]*\bid\s*=\s*[\"']?[^\"'\s>]+[^<>]*>)"), F.lit(1))
    found = lines.select("id", (F.col("p") + 1).alias("line"), F.explode(tags).alias("tag"))
    name, own = F.regexp_extract("tag", r"(?i)^<([a-z][\w-]*)", 1), F.regexp_extract("tag", r"(?i)\bid\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return found.select("id", "line", F.concat(F.lit("#"), own).alias("name"), F.concat(F.lit("<"), F.lower(name), F.lit(' id="'), own, F.lit('">')).alias("signature"))


def css_rules(sheets: DataFrame) -> DataFrame:
    """``id, ordinal, name``: the selectors of each rule in ``sheets(id, css)``, white space collapsed."""
    plain = F.regexp_replace("css", r"(?s)/\*.*?\*/", " ")
    heads = F.regexp_extract_all(plain, F.lit(r"([^{}@;]+)\{"), F.lit(1))
    return sheets.select("id", F.posexplode(heads).alias("ordinal", "head")).select("id", "ordinal", F.trim(F.regexp_replace("head", r"\s+", " ")).alias("name")).where("name != ''")
