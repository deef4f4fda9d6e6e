"""Generated, minified, vendored and data files saved as code.

A multi-pattern automaton reads the notices in the comments at the head of each file, which a
comment lexer delimits however long they are; path rules know vendored folders, lockfiles and the
suffixes of generators and minifiers; and two measures of the whole text, made by Spark's own
string functions, find code that was squeezed and files that are nothing but literals. Only texts
that begin with a comment go to Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.paths import basename, code_language
from corvane.session import ship_package, spread

#: Languages whose files count as code.
CODE = ("python", "javascript", "typescript", "cpp", "c_sharp", "go")

#: Phrases of notices, in lower case. Each names what it tells; ``a & b`` needs both
#: in one line. Copies of other projects are told by a grant to copy, or by a copyright that a
#: project's contributors hold together.
NOTICES = {
    "do not edit": "generated",
    "do not modify": "generated",
    "do not change this file": "generated",
    "<auto-generated": "generated",
    "auto-generated file": "generated",
    "autogenerated": "generated",
    "automatically generated": "generated",
    "@generated": "generated",
    "machine made": "generated",
    "machine generated": "generated",
    "machine-generated": "generated",
    "this code was generated": "generated",
    "this file was generated": "generated",
    "this file is generated": "generated",
    "edit that file instead": "generated",
    "manual changes will be lost": "generated",
    "changes will be overwritten": "generated",
    "regenerate with": "generated",
    "source: & .proto": "generated",
    "upstream copy": "vendored",
    "vendored from": "vendored",
    "imported from upstream": "vendored",
    "copied verbatim from": "vendored",
    "permission is granted to copy": "vendored",
    "permission is hereby granted": "vendored",
    "permission to use, copy": "vendored",
    "redistribution and use in source": "vendored",
    "copyright & contributors": "vendored",
    "copyright & maintainers": "vendored",
    "copyright & developers": "vendored",
    "copyright & authors": "vendored",
    "(c) & contributors": "vendored",
    "(c) & maintainers": "vendored",
    "(c) & developers": "vendored",
    "(c) & authors": "vendored",
}

#: Phrases that take a comment line back.
DENIALS = ("maintained by hand", "hand-written", "handwritten", "no longer generated", "was generated by")

#: Folders of other projects' code; a project's folder has to follow.
VENDORED_DIR = (
    r"(?i)(^|/)(node_modules|bower_components|jspm_packages|site-packages|third[_-]?party|3rd[_-]?party|"
    r"vendor|pods|deps|external|contrib)/[^/]+/"
)
GENERATED_NAME = (
    r"(?i)(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|cpp|h|hpp)|_pb\.m?[jt]s|\.g\.(i\.)?(cs|ts|js)|"
    r"[._]generated\.\w+|\.gen\.\w+|_gen\.go|\.designer\.cs|zz_generated\w*\.go|_moc\.(cpp|cc|h|hpp)|(^|/)moc_\w+\.(cpp|cc|h))$"
)
MINIFIED_NAME = r"(?i)[.-]min\.(m?js|css)$"
LOCKFILE_NAME = (
    r"(?i)^(package-lock\.json|npm-shrinkwrap\.json|packages\.lock\.json|yarn\.lock|pnpm-lock\.yaml|"
    r"poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum)$"
)
#: What may stand at the head of a file: blanks, comments, include guards and pragmas, and also line
#: numbers of a listing and conflict markers. The named groups hold what comments say.
_LEAD = re.compile(
    r"[\s\ufeff]+|(?:<{7}|={7}|>{7}|\|{7})[^\n]*|\d+[ \t]*\||\#[ \t]*(?:ifndef|define|pragma|nullable)\b[^\n]*|"
    r"//(?P<a>[^\n]*)|\#(?P<b>[^\n]*)|/\*(?P<c>.*?)(?:\*/|\Z)|<!--(?P<d>.*?)(?:-->|\Z)",
    re.S,
)
#: How a text begins that has a comment at its head.
_BEGINS = r"\A[\s\x{FEFF}]*+(?:<{7}|\d+[ \t]*+\||//|#|/\*|<!--)"
#: A literal with the separators after it.
_LITERAL = r"""(?:"[^"\n]*"|'[^'\n]*'|[-+]?0[xX][0-9a-fA-F]+|[-+]?\d+(?:\.\d+)?)[\s,;]*"""

#: A file of at least this many characters that has less than DATA_REST of them outside of literals
#: is data; one whose lines are at least LONG_LINES long on average and that has less than
#: FEW_SPACES white space is minified.
DATA_CHARS, DATA_REST, LONG_LINES, FEW_SPACES = 300, 0.12, 150, 0.06


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word in {p for rule in NOTICES for p in rule.split(" & ")} | set(DENIALS):
        words.add_word(word, word)
    words.make_automaton()
    return words


def head_comments(text: str) -> list[str]:
    """The lines of all comments before the first code of a text, in lower case."""
    lines: list[str] = []
    at = 0
    while m := _LEAD.match(text, at):
        at = m.end()
        if m.lastgroup:
            lines.extend(m[m.lastgroup].lower().split("\n"))
    return lines


def notice_of(text: str | None, words: ahocorasick.Automaton) -> str | None:
    """What the comments at the head of a file tell: ``generated``, ``vendored`` or nothing. A line
    that takes it back tells nothing."""
    kinds = set()
    for line in head_comments(text or ""):
        hits = {word for _, word in words.iter(line)}
        if hits and not hits.intersection(DENIALS):
            kinds |= {kind for rule, kind in NOTICES.items() if hits.issuperset(rule.split(" & "))}
    return min(kinds, default=None)


def _notices(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    words = _automaton()
    for batch in texts:
        yield batch.map(lambda t: notice_of(t, words) if t else None)


def _share_outside_literals(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, _LITERAL, "")) / F.char_length(text)


def classify_files(raw_files: DataFrame) -> DataFrame:
    """``file_id, repo_id, path, language, origin`` of every row of ``raw_files``.

    ``origin`` is ``lockfile``, ``vendored``, ``generated``, ``data``, ``minified`` or
    ``hand_written``, the first that holds in this order. Rows are kept as they are, repeated ones
    too. A null path has no language and decides nothing, a null or empty text is hand-written
    unless its path says otherwise. Text is read whole, and so are the comments at its head.
    """
    ship_package(raw_files.sparkSession)
    path, text = F.col("path"), F.col("text")
    commented = F.when(code_language(path).isin(*CODE) & text.rlike(_BEGINS), text)
    size = F.char_length(text)
    lines = size - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    long_lines = (size >= DATA_CHARS) & (size / lines >= LONG_LINES)
    few_spaces = F.when(
        long_lines, F.char_length(F.regexp_replace(text, r"\s+", "")) / size > 1 - FEW_SPACES
    ).otherwise(False)
    is_code = F.col("language").isin(*CODE)
    data = F.when((size >= DATA_CHARS) & is_code, _share_outside_literals(text) < DATA_REST).otherwise(False)
    tagged = spread(raw_files.select("file_id", "repo_id", "path", "text")).select(
        "file_id", "repo_id", "path", code_language(path).alias("language"), "text", F.pandas_udf(_notices, "string")(commented).alias("__notice")
    )
    origin = (
        F.when(basename(path).rlike(LOCKFILE_NAME), "lockfile")
        .when(path.rlike(VENDORED_DIR) | path.rlike("^vendor/") | (F.col("__notice") == "vendored"), "vendored")
        .when(path.rlike(GENERATED_NAME) | (F.col("__notice") == "generated"), "generated")
        .when(data, "data")
        .when(path.rlike(MINIFIED_NAME) | (few_spaces & is_code), "minified")
        .otherwise("hand_written")
    )
    return tagged.select("file_id", "repo_id", "path", "language", origin.alias("origin"))


def machine_made(raw_files: DataFrame) -> DataFrame:
    """``file_id`` of code files that nobody of this project wrote by hand, each once."""
    return (
        classify_files(raw_files)
        .where(F.col("language").isin(*CODE) & (F.col("origin") != "hand_written"))
        .select("file_id")
        .distinct()
    )
