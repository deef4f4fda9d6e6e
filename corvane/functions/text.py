"""Column expressions on code and text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.paths import basename, mapped


#: Words that a query does not search for.
STOPWORDS = (
    "the and for with this that where what which how when are was from into out not but has have does did use used "
    "using get set add new all implemented implement function method class code find fix after before should would "
    "could can missing"
).split()

#: Labels of effects and entry points, with the texts that hint at them.
SIDE_EFFECTS = {
    "writes_disk": ["open(", ".write(", "write_text", "write_bytes", "to_csv", "savefig", "mkdir(", "makedirs"],
    "deletes": ["unlink(", "rmtree", "os.remove", "drop table", "delete from"],
    "network": ["requests.", "httpx", "urllib", "socket.", "http://", "https://", "fetch("],
    "database": ["execute(", ".cursor(", "insert into", "update ", "commit("],
    "subprocess": ["subprocess", "os.system", "popen"],
    "mutates_global": ["global ", "os.environ"],
}
ENTRYPOINTS = {
    "cli_command": ["@app.command", "typer.", "argparse", "click.command"],
    "api_route": ["@app.route", "@router.", "@app.get", "@app.post", "fastapi"],
    "mcp_tool": ["@mcp.tool"],
    "main": ["__main__"],
    "test": ["def test_", "pytest", "unittest"],
}
#: Languages by extension, as the index names them.
INDEX_LANGUAGES = {
    "py": "python", "pyi": "python", "cs": "c_sharp", "csproj": "xml", "props": "xml", "targets": "xml", "sln": "text",
    "razor": "html", "cshtml": "html", "xaml": "xml", "vb": "text", "fs": "text", "fsx": "text", "js": "javascript",
    "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "dart": "dart",
    "java": "java", "go": "go", "rb": "ruby", "rs": "rust", "php": "php", "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp",
    "hpp": "cpp", "hh": "cpp", "md": "markdown", "markdown": "markdown", "rst": "text", "txt": "text", "json": "json",
    "jsonc": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "htm": "html",
    "css": "css", "scss": "css", "sql": "sql", "sh": "bash", "bash": "bash", "ps1": "text", "ini": "ini", "cfg": "ini",
    "conf": "ini",
}
PARSEABLE = ("python", "cpp", "c_sharp", "javascript", "typescript", "tsx", "dart", "html", "css")
PROSE = ("markdown", "text", "rst", "asciidoc")
#: Names of files that orient, and hints of entry files.
IMPORTANT = (
    "readme", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "requirements.txt", "dockerfile", "makefile",
    "cargo.toml", "go.mod", ".csproj", ".sln",
)
ENTRY_FILES = ("main.py", "__main__.py", "app.py", "/cli/", "/server/", "manage.py", "index.js", "index.ts", "program.cs")


def strip(text: Column) -> Column:
    """A text without white space of any kind around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """The lines of a text; a final line end does not open a further line."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(F.length(plain) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, r"\n\z", ""), "\n"))


def line_slice(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, both from 1 and inclusive, as one text."""
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def normalize_code(text: Column) -> Column:
    """Lines without white space around them, blank lines dropped."""
    return F.array_join(F.filter(F.transform(lines_of(text), strip), lambda x: x != ""), "\n")


def signature_hash(signature: Column) -> Column:
    """Hash of a signature with its white space collapsed; null for none."""
    flat = F.trim(F.regexp_replace(signature, r"\s+", " "))
    return F.when(F.length(signature) > 0, F.sha2(flat, 256))


def fingerprint(code: Column) -> Column:
    """Hash of a body without its first line; null if nothing is left."""
    lines = lines_of(code)
    body = F.array_join(F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), strip), lambda x: x != ""), "\n")
    return F.when(body != "", F.sha2(body, 256))


def short_id(prefix: str, digits: int, *parts: Column) -> Column:
    """A deterministic id: the first digits of the SHA-1 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, digits))


def first_sentence(text: Column, limit: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    end = F.locate(". ", flat)
    cut = F.when(end > 0, F.substring(flat, F.lit(1), end)).otherwise(flat)
    return F.substring(cut, 1, limit)


def chunk_summary(content: Column) -> Column:
    """The first line that is neither blank nor a comment, else the first that is not blank."""
    lines = F.filter(F.transform(lines_of(content), strip), lambda x: x != "")
    code = F.filter(lines, lambda x: ~x.rlike(r"^(#|//|/\*|\*|<!--)"))
    return F.substring(F.coalesce(F.try_element_at(code, F.lit(1)), F.try_element_at(lines, F.lit(1)), F.lit("")), 1, 120)


def identifier_words(name: Column) -> Column:
    """Parts of an identifier of three letters or more, in lower case, each once, twelve at most."""
    parts = F.regexp_extract_all(name, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$|[._])|\d+)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(parts, F.lower), lambda w: F.length(w) > 2)), 1, 12)


def query_tokens(query: Column) -> Column:
    """Identifiers of a query of three letters or more without stop words, in their case and order."""
    tokens = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*STOPWORDS)))


def terms_of(text: Column) -> Column:
    """Distinct word parts of three characters or more in lower case, split at changes of case."""
    parts = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(r"([A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1)
    )
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda w: F.length(w) >= 3), F.lower)))


def hinted(text: Column, hints: dict[str, list[str]]) -> Column:
    """The labels of which one hint occurs in a text, in the order of the table."""
    low = F.lower(text)
    found = []
    for label, texts in hints.items():
        hit = F.lit(False)
        for t in texts:
            hit = hit | F.contains(low, F.lit(t))
        found.append(F.when(hit, F.lit(label)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def domains_of(path: Column) -> Column:
    """The last four folders of a path."""
    parts = F.split(path, "/")
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    return F.slice(folders, F.greatest(F.size(folders) - 3, F.lit(1)), F.lit(4))


def is_test_path(path: Column) -> Column:
    """Whether a path is that of a test, by its folders or a word of its name."""
    low, base = F.lower(path), basename(path)
    words = F.regexp_extract_all(base, F.lit(r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1))
    named = F.arrays_overlap(F.transform(words, F.lower), F.array(F.lit("test"), F.lit("tests"), F.lit("spec")))
    return low.rlike(r"^tests?/|/tests?/") | F.lower(base).startswith("conftest") | named


def module_key(path: Column) -> Column:
    """The first two folders, the first, or (root)."""
    parts = F.split(path, "/")
    return (
        F.when(F.size(parts) <= 1, "(root)").when(F.size(parts) == 2, parts[0]).otherwise(F.concat_ws("/", parts[0], parts[1]))
    )


def top_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("(root)")


def any_of(text: Column, texts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def is_important(path: Column) -> Column:
    return any_of(F.lower(basename(path)), IMPORTANT)


def looks_entry(path: Column) -> Column:
    return any_of(F.lower(path), ENTRY_FILES)


def index_language(path: Column) -> Column:
    """Language of a path as the index names it; null for unknown extensions."""
    suffix = F.regexp_extract(F.lower(basename(path)), r".\.([^.]+)$", 1)
    return mapped(INDEX_LANGUAGES, suffix)


def token_count(text: Column) -> Column:
    """Tokens by the rule of four characters each: at least one, none for an empty text."""
    n = F.char_length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def slugify(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 40)


def build_ref(path: Column, qualified_name: Column, first: Column, last: Column, is_symbol: Column) -> Column:
    """``path::name`` for symbols, ``path:first-last`` for other spans."""
    return F.when(is_symbol & qualified_name.isNotNull(), F.concat_ws("::", path, qualified_name)).otherwise(
        F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))
    )


def ref_path(ref: Column) -> Column:
    return F.substring_index(F.substring_index(ref, "::", 1), ":", 1)


def ref_name(ref: Column) -> Column:
    """The qualified name of a symbol ref without its block, null for others."""
    bare = F.regexp_replace(ref, r"#block:.*$", "")
    return F.nullif(F.regexp_extract(bare, r"^[^:]*::(.*)$", 1), F.lit(""))


def ref_lines(ref: Column) -> tuple[Column, Column]:
    """First and last line of a line ref, null for others."""
    pattern = r"^[^:]*:(\d+)-(\d+)$"
    return (
        F.nullif(F.regexp_extract(ref, pattern, 1), F.lit("")).cast("int"),
        F.nullif(F.regexp_extract(ref, pattern, 2), F.lit("")).cast("int"),
    )


def content_type(path: Column, language: Column, chunk_type: Column) -> Column:
    return (
        F.when(F.contains(path, F.lit("/_assets/")) | path.rlike(r"\.min\.(js|css)$"), "generated")
        .when(language.isin(*PROSE), "prose")
        .when(chunk_type.isin("constant", "variable", "type"), "data")
        .otherwise("code")
    )


def visibility(kind: Column, chunk_type: Column, n_lines: Column) -> Column:
    """How a card may be shown: full, low_priority or graph_only."""
    bulk = chunk_type.isin("constant", "variable") & (n_lines > 8)
    return F.when((kind == "generated") | ((kind == "data") & bulk), "graph_only").when(kind == "data", "low_priority").otherwise("full")


def redact(text: Column) -> tuple[Column, Column]:
    """A text with secrets replaced, and how many were found."""
    rules = (
        (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "***REDACTED***"),
        (r"\bAKIA[0-9A-Z]{16}\b", "***REDACTED***"),
        (r"(?i)\b(api_?key|secret|token|password)(\s*[=:]\s*)([\"'])[^\"'\n]{8,}[\"']", "$1$2$3***REDACTED***$3"),
    )
    out, n = text, F.lit(0)
    for pattern, to in rules:
        n = n + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, to)
    return out, n


def descriptor(language: Column, scope: Column, path: Column, name: Column, signature: Column, summary: Column, tags: dict[str, Column]) -> Column:
    """Labelled lines that describe a card; empty ones but the first three are left out."""
    def line(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(label + ": "), value))

    head = [F.concat(F.lit("Language: "), F.coalesce(language, F.lit(""))), F.concat(F.lit("Scope: "), F.coalesce(scope, F.lit(""))), F.concat(F.lit("Path: "), path)]
    rest = [line("Qualified name", name), line("Signature", signature), line("Summary", summary)]
    labels = [line(label, F.array_join(values, ", ")) for label, values in tags.items()]
    return F.concat_ws("\n", *head, *rest, *labels)
