"""Scalar functions of the index over its own tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans import base
from corvane.plans.registry import query
from corvane.tables import load

_W = f"WITH {base.SQL} "
_PLAIN = "regexp_replace({c}, '\\r\\n?', chr(10), 'g')"
_LINES = "string_split(regexp_replace(" + _PLAIN + ", '\\n\\z', ''), chr(10))"
_TRIMMED = "list_filter(list_transform(" + _LINES + ", lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _hints(column: str, table: dict[str, list[str]]) -> str:
    cases = []
    for label, texts in table.items():
        any_hit = " OR ".join(f"contains(lower({column}), '{t}')" for t in texts)
        cases.append(f"CASE WHEN {any_hit} THEN '{label}' END")
    return "list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL)"


@query(
    "ids_and_hashes",
    """
    SELECT id AS chunk_id, sha256(content) AS content_sha,
           'file_' || left(sha1(concat_ws(chr(0), repo_id, path)), 16) AS file_id,
           'chunk_' || left(sha1(concat_ws(chr(0), path, CAST(start_line AS VARCHAR), chunk_type)), 16) AS span_id
    FROM c""".replace("SELECT id", _W + "SELECT id"),
)
def ids_and_hashes(spark, folder):
    c = base.chunks(spark, folder)
    return c.select(
        F.col("id").alias("chunk_id"),
        F.sha2("content", 256).alias("content_sha"),
        T.short_id("file_", 16, F.col("repo_id"), F.col("path")).alias("file_id"),
        T.short_id("chunk_", 16, F.col("path"), F.col("start_line").cast("string"), F.col("chunk_type")).alias("span_id"),
    )


@query(
    "normalize_and_fingerprint",
    _W
    + f"""SELECT file_id, sha256(array_to_string({_TRIMMED.format(c='text')}, chr(10))) AS normal_sha,
      CASE WHEN len(list_filter(list_transform({_LINES.format(c='text')}[2:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) > 0
           THEN sha256(array_to_string(list_filter(list_transform({_LINES.format(c='text')}[2:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))) END AS fingerprint
      FROM r""",
)
def normalize_and_fingerprint(spark, folder):
    r = base.texts(spark, folder)
    return r.select("file_id", F.sha2(T.normalize_code(F.col("text")), 256).alias("normal_sha"), T.fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "signature_hashes",
    """SELECT DISTINCT id AS symbol_id, CASE WHEN length(signature) > 0
       THEN sha256(trim(regexp_replace(signature, '\\s+', ' ', 'g'))) END AS signature_hash FROM symbols""",
)
def signature_hashes(spark, folder):
    s = load(spark, folder, "symbols")
    return s.select(F.col("id").alias("symbol_id"), T.signature_hash(F.col("signature")).alias("signature_hash")).distinct()


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    "query_tokens",
    f"""SELECT doc_id, list_distinct_in_order AS tokens FROM (
        SELECT doc_id, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_position(t, t[i]) = i THEN t[i] END), lambda x: x IS NOT NULL) AS list_distinct_in_order
        FROM (SELECT doc_id, list_filter(regexp_extract_all(coalesce(title, ''), '[A-Za-z_][A-Za-z0-9_]*'),
                     lambda x: length(x) >= 3 AND lower(x) NOT IN ({_STOP})) AS t FROM documents))""",
)
def query_tokens(spark, folder):
    return load(spark, folder, "documents").select("doc_id", T.query_tokens(F.col("title")).alias("tokens"))


def _terms(text: str) -> str:
    """Word parts as SQL, which cannot look ahead: changes of case become blanks first."""
    parts = f"regexp_extract_all(regexp_replace(coalesce({text}, ''), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z]+|[a-z]+|[A-Z]+|[0-9]+')"
    return f"list_sort(list_distinct(list_transform(list_filter({parts}, lambda x: length(x) >= 3), lambda x: lower(x))))"


@query(
    "identifier_words",
    _W
    + f"""SELECT id, list_transform(list_sort(list_transform(list_distinct(w), lambda x: struct_pack(p := list_position(w, x), x := x)))[1:12], lambda y: y.x) AS words, {_terms('name')} AS terms
      FROM (SELECT id, name, list_transform(list_filter(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z])([^A-Z._])', '\\1 \\2\\3', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: length(x) > 2), lambda x: lower(x)) AS w FROM s)""",
)
def identifier_words(spark, folder):
    """Word parts of symbol names, in order, and as query terms."""
    s = base.symbols(spark, folder)
    return s.select("id", T.identifier_words(F.col("name")).alias("words"), T.terms_of(F.col("name")).alias("terms"))


@query(
    "chunk_summaries",
    _W
    + f"""SELECT id, left(coalesce(list_filter(l, lambda x: NOT regexp_matches(x, '^(#|//|/\\*|\\*|<!--)'))[1], l[1], ''), 120) AS summary_line,
      left(CASE WHEN strpos(flat, '. ') > 0 THEN left(flat, strpos(flat, '. ')) ELSE flat END, 160) AS sentence
      FROM (SELECT id, {_TRIMMED.format(c='content')} AS l, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS flat FROM c)""",
)
def chunk_summaries(spark, folder):
    c = base.chunks(spark, folder)
    return c.select("id", T.chunk_summary(F.col("content")).alias("summary_line"), T.first_sentence(F.col("content")).alias("sentence"))


@query(
    "heuristic_tags",
    _W
    + f"""SELECT id, {_hints('content', T.SIDE_EFFECTS)} AS side_effects, {_hints('content', T.ENTRYPOINTS)} AS entrypoints,
      list_filter(string_split(path, '/')[:-2], lambda x: x <> '')[-4:] AS domain FROM c""",
)
def heuristic_tags(spark, folder):
    c = base.chunks(spark, folder)
    return c.select(
        "id",
        T.hinted(F.col("content"), T.SIDE_EFFECTS).alias("side_effects"),
        T.hinted(F.col("content"), T.ENTRYPOINTS).alias("entrypoints"),
        T.domains_of(F.col("path")).alias("domain"),
    )


@query(
    "descriptors",
    _W
    + f"""SELECT id, concat_ws(chr(10), 'Language: ' || coalesce(language, ''), 'Scope: ' || scope, 'Path: ' || path,
        CASE WHEN length(qualified_name) > 0 THEN 'Qualified name: ' || qualified_name END,
        CASE WHEN length(summary) > 0 THEN 'Summary: ' || summary END,
        CASE WHEN len(d) > 0 THEN 'Domain: ' || array_to_string(d, ', ') END,
        CASE WHEN len(e) > 0 THEN 'Side effects: ' || array_to_string(e, ', ') END) AS descriptor
      FROM (SELECT *, CASE WHEN chunk_type IN ('class', 'method', 'function') THEN 'symbol' WHEN chunk_type = 'file' THEN 'file' ELSE 'code' END AS scope,
            list_filter(string_split(path, '/')[:-2], lambda x: x <> '')[-4:] AS d, {_hints('content', T.SIDE_EFFECTS)} AS e FROM c)""",
)
def descriptors(spark, folder):
    c = base.chunks(spark, folder)
    scope = F.when(F.col("chunk_type").isin("class", "method", "function"), "symbol").when(F.col("chunk_type") == "file", "file").otherwise("code")
    return c.select(
        "id",
        T.descriptor(
            F.col("language"), scope, F.col("path"), F.col("qualified_name"), F.lit(None).cast("string"), F.col("summary"),
            {"Domain": T.domains_of(F.col("path")), "Side effects": T.hinted(F.col("content"), T.SIDE_EFFECTS)},
        ).alias("descriptor"),
    )


_BASE = "regexp_extract(path, '[^/]*$')"


@query(
    "path_flags",
    _W
    + f"""SELECT id, path, regexp_matches(lower(path), '^tests?/|/tests?/') OR starts_with(lower({_BASE}), 'conftest')
        OR len(list_intersect(list_transform(regexp_extract_all(regexp_replace(regexp_replace({_BASE}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+|[0-9]+'), lambda x: lower(x)), ['test', 'tests', 'spec'])) > 0 AS is_test,
      CASE len(string_split(path, '/')) WHEN 1 THEN '(root)' WHEN 2 THEN split_part(path, '/', 1) ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS module_key,
      CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS top_folder,
      {' OR '.join(f"contains(lower({_BASE}), '{x}')" for x in T.IMPORTANT)} AS is_important,
      {' OR '.join(f"contains(lower(path), '{x}')" for x in T.ENTRY_FILES)} AS looks_entry
      FROM f""",
)
def path_flags(spark, folder):
    f = base.files(spark, folder)
    p = F.col("path")
    return f.select(
        "id", "path", T.is_test_path(p).alias("is_test"), T.module_key(p).alias("module_key"), T.top_folder(p).alias("top_folder"),
        T.is_important(p).alias("is_important"), T.looks_entry(p).alias("looks_entry"),
    )


_LANG = "map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.INDEX_LANGUAGES.items()) + "}, regexp_extract(lower(regexp_extract({p}, '[^/]*$')), '.\\.([^.]+)$', 1))[1]"


@query(
    "detect_language",
    _W + f"SELECT id, {_LANG.replace('{p}', 'path')} AS detected, coalesce({_LANG.replace('{p}', 'path')} IN {T.PARSEABLE}, false) AS parseable FROM f",
)
def detect_language(spark, folder):
    f = base.files(spark, folder)
    language = T.index_language(F.col("path"))
    return f.select("id", language.alias("detected"), F.coalesce(language.isin(*T.PARSEABLE), F.lit(False)).alias("parseable"))


@query(
    "token_counts",
    _W + "SELECT chunk_type, count(*) AS n_chunks, CAST(sum(CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END) AS BIGINT) AS n_tokens FROM c GROUP BY 1",
)
def token_counts(spark, folder):
    c = base.chunks(spark, folder)
    return c.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(T.token_count(F.col("content"))).cast("bigint").alias("n_tokens"))


_SECRETS = [
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----", "***REDACTED***"),
    ("\\bAKIA[0-9A-Z]{16}\\b", "***REDACTED***"),
]


@query(
    "redact_secrets",
    """SELECT doc_id, n AS n_redacted, md5(t) AS text_md5 FROM (
      SELECT doc_id, len(regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----'))
        + len(regexp_extract_all(text, '\\bAKIA[0-9A-Z]{16}\\b'))
        + len(regexp_extract_all(text, '(?i)\\b(api_?key|secret|token|password)(\\s*[=:]\\s*)(["''])[^"''\\n]{8,}["'']')) AS n,
      regexp_replace(regexp_replace(regexp_replace(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----', '***REDACTED***', 'g'),
        '\\bAKIA[0-9A-Z]{16}\\b', '***REDACTED***', 'g'),
        '(?i)\\b(api_?key|secret|token|password)(\\s*[=:]\\s*)(["''])[^"''\\n]{8,}["'']', '\\1\\2\\3***REDACTED***\\3', 'g') AS t FROM documents)""",
)
def redact_secrets(spark, folder):
    d = load(spark, folder, "documents")
    text, n = T.redact(F.col("text"))
    return d.select("doc_id", n.cast("bigint").alias("n_redacted"), F.md5(text.cast("binary")).alias("text_md5"))


@query(
    "refs_round_trip",
    _W
    + """SELECT id, path || CASE WHEN chunk_type IN ('class', 'method', 'function') AND qualified_name IS NOT NULL THEN '::' || qualified_name
        ELSE ':' || start_line || '-' || coalesce(end_line, start_line) END AS ref, path AS ref_path,
        CASE WHEN chunk_type IN ('class', 'method', 'function') THEN nullif(qualified_name, '') END AS ref_name FROM c""",
)
def refs_round_trip(spark, folder):
    """Refs as they are built, read back into path and name."""
    c = base.chunks(spark, folder)
    is_symbol = F.coalesce(F.col("chunk_type").isin("class", "method", "function"), F.lit(False))
    ref = T.build_ref(F.col("path"), F.col("qualified_name"), F.col("start_line"), F.coalesce("end_line", "start_line"), is_symbol)
    return c.select("id", ref.alias("ref")).select("id", "ref", T.ref_path(F.col("ref")).alias("ref_path"), T.ref_name(F.col("ref")).alias("ref_name"))


@query(
    "card_visibility",
    _W
    + f"""SELECT id, kind AS content_type, CASE WHEN kind = 'generated' OR kind = 'data' AND bulk THEN 'graph_only' WHEN kind = 'data' THEN 'low_priority' ELSE 'full' END AS visibility
      FROM (SELECT id, chunk_type IN ('constant', 'variable') AND end_line - start_line + 1 > 8 AS bulk, CASE WHEN contains(path, '/_assets/') OR regexp_matches(path, '\\.min\\.(js|css)$') THEN 'generated'
        WHEN {_LANG.replace('{p}', 'path')} IN {T.PROSE} THEN 'prose' WHEN chunk_type IN ('constant', 'variable', 'type') THEN 'data' ELSE 'code' END AS kind FROM c)""",
)
def card_visibility(spark, folder):
    c = base.chunks(spark, folder)
    kind = T.content_type(F.col("path"), T.index_language(F.col("path")), F.col("chunk_type"))
    lines = F.col("end_line") - F.col("start_line") + 1
    return c.select("id", "chunk_type", kind.alias("content_type"), lines.alias("n")).select("id", "content_type", T.visibility(F.col("content_type"), F.col("chunk_type"), F.coalesce("n", F.lit(0))).alias("visibility"))
