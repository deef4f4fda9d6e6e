"""Graph, chunking, refs and evaluation over the code index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking as C
from corvane.operators import evaluation as E
from corvane.operators import graph as G
from corvane.operators import retrieval as R
from corvane.plans import base
from corvane.plans.map_queries import _MODULE
from corvane.plans.registry import query
from corvane.plans.text_queries import _LINES
from corvane.tables import load

_NO = ", ".join(f"'{w}'" for w in G.NO_CALLS)
_CALLS = f"""
bo AS (SELECT symbol_id, content FROM c WHERE chunk_type IN ('function', 'method') AND symbol_id IS NOT NULL),
ns AS (SELECT *, split_part(qname, '.', -1) AS nm, nullif(regexp_extract(qname, '^(.*)\\.[^.]*$', 1), '') AS owner, split_part(nullif(regexp_extract(qname, '^(.*)\\.[^.]*$', 1), ''), '.', -1) AS parent,
    regexp_extract(regexp_extract(path, '[^/]*$'), '^(.*?)(?:\\.[^.]*)?$', 1) AS stem
  FROM (SELECT id, repo_id, file_id, coalesce(language, '') AS language, path, replace(coalesce(qualified_name, name), '::', '.') AS qname FROM gs)),
ce AS (SELECT DISTINCT source_id, receiver, CASE WHEN receiver IS NULL THEN 'bare' WHEN receiver = 'self' THEN 'self' WHEN receiver = 'this' THEN 'this' WHEN scoped THEN 'qualified' ELSE 'name' END AS kind, e.name
  FROM (SELECT symbol_id AS source_id, CASE WHEN contains(parts, '.') THEN split_part(parts, '.', 1) END AS receiver, regexp_extract(parts, '[^.]*$') AS name, contains(call, '::') AS scoped
    FROM (SELECT symbol_id, call, regexp_replace(call, '::|->', '.', 'g') AS parts FROM (SELECT symbol_id, unnest(regexp_extract_all(content, '((?:[A-Za-z_]\\w*(?:\\.|::|->))?[A-Za-z_]\\w*)\\(', 1)) AS call FROM bo))) e
  JOIN (SELECT id, nm AS own FROM ns) o ON o.id = e.source_id WHERE e.name NOT IN ({_NO}) AND (e.name <> own OR receiver IS NOT NULL)),
ee AS (SELECT ce.*, n.repo_id, n.language, n.file_id, n.owner || '.' || ce.name AS inside FROM ce JOIN ns n ON n.id = ce.source_id),
hi AS (
  SELECT ee.source_id, ee.name, ee.receiver, ee.kind, t.id, 1 AS ord FROM ee JOIN ns t ON t.repo_id = ee.repo_id AND t.language = ee.language AND t.qname = ee.inside WHERE ee.kind IN ('self', 'this')
  UNION ALL SELECT ee.source_id, ee.name, ee.receiver, ee.kind, t.id, 2 FROM ee JOIN ns t ON t.repo_id = ee.repo_id AND t.language = ee.language AND t.parent = ee.receiver AND t.nm = ee.name WHERE ee.kind = 'qualified'
  UNION ALL SELECT ee.source_id, ee.name, ee.receiver, ee.kind, t.id, 3 FROM ee JOIN ns t ON t.repo_id = ee.repo_id AND t.language = ee.language AND t.stem = ee.receiver AND t.nm = ee.name WHERE ee.kind = 'name'
  UNION ALL SELECT ee.source_id, ee.name, ee.receiver, ee.kind, t.id, 4 FROM ee JOIN ns t ON t.repo_id = ee.repo_id AND t.language = ee.language AND t.file_id = ee.file_id AND t.nm = ee.name WHERE ee.kind = 'bare'
  UNION ALL SELECT ee.source_id, ee.name, ee.receiver, ee.kind, t.id, 5 FROM ee JOIN ns t ON t.repo_id = ee.repo_id AND t.language = ee.language AND t.nm = ee.name),
fi AS (SELECT * FROM (SELECT *, min(ord) OVER (PARTITION BY source_id, name, receiver, kind) AS best FROM hi) WHERE ord = best),
rc AS (SELECT source_id, name, receiver, kind, ['class', 'scope', 'module', 'file', 'name'][ord] AS rule, CASE WHEN n = 1 OR ord = 1 THEN least END AS target_id, n AS n_candidates,
    (CASE WHEN n = 1 OR ord = 1 THEN [0.9, 0.8, 0.8, 0.8, 0.6][ord] ELSE [0.9, 0.4, 0.4, 0.4, 0.35][ord] END)::DOUBLE AS confidence, n > 1 AND ord > 1 AS ambiguous
  FROM (SELECT source_id, name, receiver, kind, ord, count(*) AS n, min(id) AS least FROM fi GROUP BY ALL)),
sz AS (SELECT repo_id, language, nm AS name, count(*) AS n FROM ns GROUP BY ALL),
th AS (SELECT DISTINCT repo_id, coalesce(t, 1073741824)::BIGINT AS threshold FROM ns LEFT JOIN (
    SELECT repo_id, greatest(8, list_sort(list(n))[least(count(*) - 1, count(*) * 9 // 10) + 1]) AS t FROM sz WHERE n >= 2 GROUP BY 1) USING (repo_id)),
su AS (SELECT rc.source_id, rc.name, rc.receiver, rc.kind, sz.n AS collisions, sz.n >= threshold AS suppressed FROM rc JOIN ns ON ns.id = rc.source_id JOIN sz ON sz.repo_id = ns.repo_id AND sz.language = ns.language AND sz.name = rc.name
    JOIN th ON th.repo_id = ns.repo_id WHERE ambiguous),
cl AS (SELECT target_id, source_id, min(tier) AS tier, max((CASE WHEN tier = 'confident' THEN 1 ELSE 0 END, confidence))[2] AS confidence FROM (
    SELECT target_id, source_id, confidence, CASE WHEN confidence >= 0.6 THEN 'confident' WHEN confidence >= 0.4 THEN 'possible' END AS tier FROM rc WHERE NOT ambiguous
    UNION ALL SELECT fi.id, fi.source_id, rc.confidence, 'possible' FROM fi JOIN rc ON rc.ambiguous AND rc.source_id = fi.source_id AND rc.name = fi.name AND rc.kind = fi.kind AND rc.receiver IS NOT DISTINCT FROM fi.receiver
      JOIN su ON NOT suppressed AND su.source_id = fi.source_id AND su.name = fi.name AND su.kind = fi.kind AND su.receiver IS NOT DISTINCT FROM fi.receiver)
  WHERE tier IS NOT NULL AND source_id <> target_id GROUP BY 1, 2)
"""
_G = f"WITH {base.SQL}, {base.GRAPH_SQL}, {_CALLS} "
_S = f"WITH {base.SQL}, {base.GRAPH_SQL} "


def _edges(spark, folder):
    s = base.graph_symbols(spark, folder)
    bodies = base.chunks(spark, folder).where(F.col("chunk_type").isin("function", "method") & F.col("symbol_id").isNotNull())
    return G.call_edges(s, bodies.select("symbol_id", "content")), s


def _resolved(spark, folder):
    edges, s = _edges(spark, folder)
    return G.resolve_calls(edges, s), s


@query("call_edges", _G + "SELECT * FROM ce")
def call_edges(spark, folder):
    """Calls in the bodies of functions and methods, not yet resolved."""
    return _edges(spark, folder)[0]


@query("resolve_edges", _G + "SELECT * FROM rc")
def resolve_edges(spark, folder):
    """Calls resolved to symbols of the same repository and language, one row a call."""
    return _resolved(spark, folder)[0].drop("key")


@query("callees", _G + "SELECT source_id, target_id, max(confidence) AS confidence, arg_max(rule, (confidence, rule)) AS rule FROM rc WHERE NOT ambiguous AND source_id <> target_id GROUP BY 1, 2")
def callees(spark, folder):
    """What each symbol calls for certain, with the best evidence."""
    r = _resolved(spark, folder)[0].where("NOT ambiguous AND source_id != target_id")
    return r.groupBy("source_id", "target_id").agg(F.max(F.struct("confidence", "rule")).alias("b")).select("source_id", "target_id", "b.confidence", "b.rule")


@query(
    "callees_suppressed",
    _G
    + """, mm AS (SELECT fi.source_id, fi.name, suppressed, collisions, count(*) AS n FROM fi JOIN su ON su.source_id = fi.source_id AND su.name = fi.name AND su.kind = fi.kind AND su.receiver IS NOT DISTINCT FROM fi.receiver
      WHERE fi.id <> fi.source_id GROUP BY ALL)
    SELECT source_id, CAST(coalesce(sum(n) FILTER (NOT suppressed), 0) AS BIGINT) AS n_listed, CAST(coalesce(sum(n) FILTER (suppressed), 0) AS BIGINT) AS n_suppressed, count(DISTINCT name) FILTER (suppressed) AS n_names,
      coalesce(list_transform(list_sort(list((-collisions, name)) FILTER (suppressed))[1:3], lambda x: x[2]), []) AS examples FROM mm GROUP BY 1""",
)
def callees_suppressed(spark, folder):
    """Ambiguous callees of each symbol: worth listing, or of names so common that they tell nothing."""
    return G.suppressed_callees(*_resolved(spark, folder))


@query("callers_tiers", _G + "SELECT * FROM cl")
def callers_tiers(spark, folder):
    """Who calls each symbol, for certain or possibly."""
    return G.callers(*_resolved(spark, folder))


@query("collision_threshold", _G + "SELECT * FROM th")
def collision_threshold(spark, folder):
    """From how many symbols of one name on a name tells nothing, by repository."""
    return G.collision_threshold(base.graph_symbols(spark, folder))


@query(
    "impact",
    _G
    + """, h1 AS (SELECT DISTINCT target_id, source_id FROM cl WHERE tier = 'confident'),
    h2 AS (SELECT DISTINCT a.target_id, b.source_id FROM h1 a JOIN h1 b ON b.target_id = a.source_id WHERE b.source_id <> a.target_id)
    SELECT target_id, source_id, 1 AS hop FROM h1 UNION ALL SELECT target_id, source_id, 2 FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.target_id = h2.target_id AND h1.source_id = h2.source_id)""",
)
def impact(spark, folder):
    """Direct and indirect callers of every symbol."""
    r, s = _resolved(spark, folder)
    sure = r.where(f"NOT ambiguous AND confidence >= {G.CONFIDENT} AND source_id != target_id").select("target_id", "source_id")
    return G.impact(sure, s.select(F.col("id").alias("target_id")))


@query(
    "delegation_leaves",
    _G.rstrip()
    + """, su1 AS (SELECT DISTINCT source_id, target_id FROM rc WHERE NOT ambiguous AND source_id <> target_id),
    fw AS (SELECT source_id FROM su1 JOIN gs ON gs.id = source_id WHERE symbol_type IN ('function', 'method') AND end_line - start_line + 1 BETWEEN 1 AND 15 GROUP BY source_id HAVING count(*) <= 2),
    st AS (SELECT source_id AS a, target_id AS b FROM su1 SEMI JOIN fw USING (source_id)),
    w1 AS (SELECT a, b FROM st), w2 AS (SELECT DISTINCT w1.a, st.b FROM w1 JOIN st ON st.a = w1.b), w3 AS (SELECT DISTINCT w2.a, st.b FROM w2 JOIN st ON st.a = w2.b), w4 AS (SELECT DISTINCT w3.a, st.b FROM w3 JOIN st ON st.a = w3.b)
    SELECT DISTINCT a AS symbol_id, b AS leaf_id FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4) WHERE b NOT IN (SELECT source_id FROM fw) AND a <> b""",
)
def delegation_leaves(spark, folder):
    """What thin forwarders finally forward to."""
    r, s = _resolved(spark, folder)
    return G.delegation_leaves(r, s)


@query("members", _G + "SELECT k.id AS symbol_id, m.id AS member_id FROM ns k JOIN ns m ON m.repo_id = k.repo_id AND starts_with(m.qname, k.qname || '.')")
def members(spark, folder):
    """Symbols below each symbol, at any depth."""
    return G.members(base.graph_symbols(spark, folder))


@query(
    "skeleton_edges",
    _G
    + f"""SELECT src, dst, count(*) AS n_calls FROM (SELECT m1.module AS src, m2.module AS dst FROM rc JOIN (SELECT id, {_MODULE} AS module FROM gs) m1 ON m1.id = source_id
      JOIN (SELECT id, {_MODULE} AS module FROM gs) m2 ON m2.id = target_id WHERE NOT ambiguous AND confidence >= 0.6) WHERE src <> dst GROUP BY 1, 2""",
)
def skeleton_edges(spark, folder):
    r, s = _resolved(spark, folder)
    return G.module_edges(r, s, T.module_key)


@query("graph_degree", _G + "SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM cl UNION ALL SELECT target_id FROM cl) GROUP BY 1")
def graph_degree(spark, folder):
    """Edges at each symbol, over both ends."""
    c = G.callers(*_resolved(spark, folder))
    return c.select(F.col("source_id").alias("id")).unionByName(c.select(F.col("target_id").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


_N = f"greatest(len({_LINES.format(c='text')}), 1)"


@query(
    "window_chunks",
    f"""WITH {base.SQL}, li AS (SELECT file_id, CASE WHEN length(text) = 0 THEN [] ELSE {_LINES.format(c='text')} END AS lines FROM r),
    w AS (SELECT file_id, lines, greatest(len(lines), 1) AS n, unnest(generate_series(1, greatest(1, CAST(ceil((greatest(len(lines), 1) - 10) / 50.0) * 50 - 49 AS BIGINT)), 50)) AS s FROM li)
    SELECT file_id, CAST(s AS INT) AS start_line, CAST(least(s + 59, n) AS INT) AS end_line, array_to_string(lines[s:least(s + 59, n)], chr(10)) AS content FROM w
    WHERE regexp_matches(array_to_string(lines[s:least(s + 59, n)], chr(10)), '\\S')""",
)
def window_chunks(spark, folder):
    return C.window_chunks(base.texts(spark, folder))


@query(
    "complement_gaps",
    f"""WITH {base.SQL}, li AS (SELECT lower(trim(file_id)) AS file_id, CASE WHEN length(text) = 0 THEN [] ELSE {_LINES.format(c='text')} END AS lines FROM r),
    sp AS (SELECT file_id, start_line, end_line FROM s WHERE file_id IS NOT NULL),
    mk AS (SELECT *, CASE WHEN before IS NULL OR start_line > before THEN 1 ELSE 0 END AS new FROM (SELECT *, max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp)),
    il AS (SELECT file_id, min(start_line) AS a, max(end_line) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS k FROM mk) GROUP BY file_id, k),
    gp AS (SELECT file_id, coalesce(lag(b) OVER (PARTITION BY file_id ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM il UNION ALL SELECT il.file_id, max(b) + 1, len(any_value(lines)) FROM il JOIN li ON li.file_id = il.file_id GROUP BY 1)
    SELECT file_id, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, CAST(n AS INT) AS n_filled FROM (
      SELECT gp.file_id, a, b, len(list_filter(lines[a:b], lambda x: regexp_matches(x, '\\S'))) AS n FROM gp JOIN li ON li.file_id = gp.file_id WHERE a <= b AND a <= len(lines)) WHERE n >= 4""",
)
def complement_gaps(spark, folder):
    texts = base.texts(spark, folder).withColumn("file_id", F.lower(F.trim("file_id")))
    spans = base.symbols(spark, folder).where("file_id IS NOT NULL").select("file_id", "start_line", "end_line")
    return C.complement_gaps(texts, spans)


@query(
    "file_cards",
    f"""WITH {base.SQL}, li AS (SELECT file_id, text, CASE WHEN length(text) = 0 THEN [] ELSE {_LINES.format(c='text')} END AS lines FROM r)
    SELECT file_id, CAST(greatest(len(lines), 1) AS INT) AS end_line, array_to_string(lines[1:40], chr(10)) AS content, sha256(array_to_string(lines, chr(10))) AS content_hash FROM li WHERE regexp_matches(text, '\\S')""",
)
def file_cards(spark, folder):
    return C.file_cards(base.texts(spark, folder))


@query(
    "enclosing_symbol",
    _S
    + """, pt AS (SELECT DISTINCT lower(trim(file_id)) AS file_id, start_line AS line FROM chunks WHERE lower(trim(chunk_type)) = 'ast_block')
    SELECT file_id, line, symbol_id FROM (SELECT pt.file_id, line, id AS symbol_id, row_number() OVER (PARTITION BY pt.file_id, line ORDER BY start_line DESC, end_line, id DESC) AS rn FROM pt JOIN gs ON gs.file_id = pt.file_id AND line BETWEEN start_line AND end_line) WHERE rn = 1""",
)
def enclosing_symbol(spark, folder):
    """The innermost symbol around the first line of each block."""
    points = load(spark, folder, "chunks").where("lower(trim(chunk_type)) = 'ast_block'").select(F.lower(F.trim("file_id")).alias("file_id"), F.col("start_line").alias("line")).distinct()
    return C.enclosing_symbol(points, base.graph_symbols(spark, folder))


@query(
    "ref_resolve",
    _S
    + """, rf AS (SELECT DISTINCT ref, path, qualified_name FROM c WHERE chunk_type IN ('function', 'method', 'class') AND qualified_name IS NOT NULL AND ref IS NOT NULL),
    nm AS (SELECT rf.ref, gs.id, gs.start_line FROM rf LEFT JOIN gs ON gs.path = rf.path AND replace(gs.qualified_name, '::', '.') = replace(rf.qualified_name, '::', '.'))
    SELECT ref, arg_min(id, (start_line, id)) AS symbol_id, CASE count(id) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS how FROM nm GROUP BY 1""",
)
def ref_resolve(spark, folder):
    """Symbol refs of cards resolved against the symbols of today."""
    c = base.chunks(spark, folder)
    refs = c.where(F.col("chunk_type").isin("function", "method", "class") & F.col("qualified_name").isNotNull() & F.col("ref").isNotNull()).select("ref", "path", "qualified_name").distinct()
    none = F.lit(None).cast("string")
    return C.resolve_refs(refs.withColumn("signature_hash", none).withColumn("fingerprint", none), base.graph_symbols(spark, folder))


_RESULTS = "re AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL), go AS (SELECT DISTINCT d.source AS query_id, d.doc_id AS id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND d.source IS NOT NULL)"


def _results(spark, folder):
    """Of each source the first five documents by length and its first gold document, with ranks. The
    rank of the latter is a count of what comes before it, so that no source is sorted whole."""
    d = load(spark, folder, "documents").where("source IS NOT NULL").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    gold = d.join(load(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("query_id", "id")
    sized = d.where("n_chars IS NOT NULL")
    top = R.top_k(sized, 5, [F.desc("n_chars"), F.col("id")]).select("query_id", "id", "rank")
    best = sized.join(gold, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.max(F.struct("n_chars", (-F.col("id")).alias("minus"))).alias("b"))
    before = (F.col("n_chars") > F.col("b.n_chars")) | ((F.col("n_chars") == F.col("b.n_chars")) & (F.col("id") < -F.col("b.minus")))
    first = sized.join(best, "query_id").groupBy("query_id", (-F.col("b.minus")).alias("id")).agg((F.count_if(before) + 1).alias("rank"))
    return top.unionByName(first).distinct(), gold


@query(
    "retrieval_metrics",
    f"""WITH {_RESULTS}, ea AS (SELECT go.query_id, count(*) AS n, min(rank) AS first, count(*) FILTER (rank <= 5) AS found FROM go LEFT JOIN re USING (query_id, id) GROUP BY 1)
    SELECT count(*) AS n_queries, avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END)::DOUBLE AS p_at_1, avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END)::DOUBLE AS p_at_3, avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END)::DOUBLE AS p_at_5,
      avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr, avg(found::DOUBLE / n) AS recall_at_5 FROM ea""",
)
def retrieval_metrics(spark, folder):
    """Measures of a ranking of documents by length within their source against their quality labels."""
    return E.retrieval_metrics(*_results(spark, folder))


@query(
    "edge_quality",
    _G
    + """, fo AS (SELECT DISTINCT target_id, source_id FROM cl), gd AS (SELECT DISTINCT target_id, source_id FROM cl WHERE tier = 'confident'),
    bo2 AS (SELECT coalesce(fo.target_id, gd.target_id) AS t, fo.target_id IS NOT NULL AS f, gd.target_id IS NOT NULL AS g FROM fo FULL JOIN gd ON fo.target_id = gd.target_id AND fo.source_id = gd.source_id),
    pe AS (SELECT t, count(*) FILTER (f AND g) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT f) AS fn FROM bo2 GROUP BY 1)
    SELECT sum(tp)::DOUBLE / sum(tp + fp)::DOUBLE AS precision, sum(tp)::DOUBLE / sum(tp + fn)::DOUBLE AS recall, avg(CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS exact FROM pe""",
)
def edge_quality(spark, folder):
    """All listed callers measured against the confident ones."""
    c = G.callers(*_resolved(spark, folder))
    return E.edge_quality(c, c.where("tier = 'confident'"))
