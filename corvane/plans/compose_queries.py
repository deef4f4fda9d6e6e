"""Compositions of search, graph and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import compose as K
from corvane.operators import graph as G
from corvane.operators import parsing as P
from corvane.operators import retrieval as R
from corvane.plans import base
from corvane.plans.graph_queries import _G, _S, _resolved
from corvane.plans.registry import query
from corvane.plans.search_queries import _ASKED, _CARDS, _CARRIED, _SYMBOL, _TOKENS, _W, _queries, _ranked
from corvane.plans.source_queries import _LANGUAGE, _case
from corvane.plans.text_queries import _LINES, _hints
from corvane.tables import load

_INTENT = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(coalesce(title, '')), '{h}')''' for h in hints)} THEN '{k}'" for k, hints in K.INTENTS.items()) + " ELSE 'mixed' END"


@query("query_intent", f"SELECT doc_id, {_INTENT} AS intent FROM documents")
def query_intent(spark, folder):
    return load(spark, folder, "documents").select("doc_id", K.query_intent(F.col("title")).alias("intent"))


@query("overlap_dedup")
def overlap_dedup(spark, folder):
    """Cards of each query without those that overlap a better one."""
    cards = _ranked(spark, folder)
    lines = F.size(T.lines_of(F.col("content")))
    hits = cards.select("query_id", "id", "path", "start_line", (F.col("start_line") + lines - 1).alias("end_line"), (F.col("chunk_type") == "file").alias("is_file"), "score")
    return K.overlap_dedup(hits.where("start_line IS NOT NULL").fillna(False, ["is_file"]))


_EFFECTS = f"ef AS (SELECT symbol_id, max({_hints('content', T.SIDE_EFFECTS)}) AS fx FROM c WHERE chunk_type IN ('function', 'method') AND symbol_id IS NOT NULL GROUP BY 1)"


@query(
    "edit_risks",
    _G
    + f""", {_EFFECTS}, ts AS (SELECT DISTINCT target_id FROM cl JOIN gs ON gs.id = cl.source_id WHERE tier = 'confident' AND regexp_matches(lower(path), '^tests?/|/tests?/')),
    n AS (SELECT target_id, count(*) FILTER (tier = 'confident') AS a, count(*) FILTER (tier = 'possible') AS b FROM cl GROUP BY 1)
    SELECT gs.id AS symbol_id, coalesce(a, 0) AS n_callers, coalesce(b, 0) AS n_possible, list_filter([CASE WHEN a >= 5 THEN 'high fan-in' END, CASE WHEN b > 0 THEN 'unverified callers' END,
      CASE WHEN len(fx) > 0 THEN 'side effects' END, CASE WHEN a > 0 AND ts.target_id IS NULL THEN 'no test calls it' END], lambda x: x IS NOT NULL) AS risks
    FROM gs LEFT JOIN n ON n.target_id = gs.id LEFT JOIN ef ON ef.symbol_id = gs.id LEFT JOIN ts ON ts.target_id = gs.id""",
)
def edit_risks(spark, folder):
    """Why a change of a symbol needs care."""
    r, s = _resolved(spark, folder)
    callers = G.callers(r, s)
    bodies = base.chunks(spark, folder).where(F.col("chunk_type").isin("function", "method") & F.col("symbol_id").isNotNull())
    effects = bodies.groupBy("symbol_id").agg(F.max(T.hinted(F.col("content"), T.SIDE_EFFECTS)).alias("side_effects"))
    tests = s.where(F.lower("path").rlike("^tests?/|/tests?/")).select(F.col("id").alias("source_id"))
    return K.edit_risks(s, callers, effects, callers.where("tier = 'confident'").join(tests, "source_id", "left_semi"))


#: Hops of confident callers up to the third, the least hop of each, and what becomes of a symbol's text.
_IMPACT = """h0 AS (SELECT DISTINCT target_id, source_id FROM rc WHERE NOT ambiguous AND confidence >= 0.6 AND source_id <> target_id),
h2 AS (SELECT DISTINCT a.target_id, b.source_id FROM h0 a JOIN h0 b ON b.target_id = a.source_id WHERE b.source_id <> a.target_id),
h3 AS (SELECT DISTINCT a.target_id, b.source_id FROM h2 a JOIN h0 b ON b.target_id = a.source_id WHERE b.source_id <> a.target_id),
hp AS (SELECT target_id, source_id, min(hop) AS hop FROM (SELECT *, 1 AS hop FROM h0 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY 1, 2),
pl AS (SELECT target_id, path, hop, regexp_matches(lower(path), '^tests?/|/tests?/') AS test FROM hp JOIN gs ON gs.id = hp.source_id),
ir AS (SELECT gs.id AS symbol_id, count(*) FILTER (hop = 1) AS n_direct, count(*) FILTER (hop = 1 AND test) AS n_direct_tests, count(*) FILTER (hop > 1) AS n_indirect,
    len(list_distinct(list_append(coalesce(list(pl.path) FILTER (pl.path IS NOT NULL), []), any_value(gs.path)))) AS n_files, coalesce(bool_or(test), false) AS tested FROM gs LEFT JOIN pl ON pl.target_id = gs.id GROUP BY 1),
po AS (SELECT target_id AS symbol_id, count(*) AS n_possible FROM cl WHERE tier = 'possible' GROUP BY 1)"""


def _impact(spark, folder):
    r, s = _resolved(spark, folder)
    sure = r.where(f"NOT ambiguous AND confidence >= {G.CONFIDENT} AND source_id != target_id").select("target_id", "source_id")
    hops = G.impact(sure, s.select(F.col("id").alias("target_id")), depth=3)
    possible = G.callers(r, s).where("tier = 'possible'")
    return G.impact_report(hops, possible, s, lambda p: F.lower(p).rlike("^tests?/|/tests?/")), s


@query("impact_report", _G.rstrip() + f", {_IMPACT} SELECT symbol_id, n_direct, n_direct_tests, n_indirect, coalesce(n_possible, 0) AS n_possible, n_files, tested FROM ir LEFT JOIN po USING (symbol_id)")
def impact_report(spark, folder):
    """Who is affected by a change of each symbol, over three hops."""
    return _impact(spark, folder)[0]


@query(
    "edit_plan",
    _G.rstrip()
    + f""", {_IMPACT}, {_EFFECTS},
    li AS (SELECT lower(trim(file_id)) AS file_id, CASE WHEN length(text) = 0 THEN [] ELSE {_LINES.format(c='text')} END AS lines FROM r),
    sl AS (SELECT DISTINCT gs.id AS symbol_id, true AS stale FROM gs JOIN li USING (file_id) WHERE content_hash IS NOT NULL AND sha256(array_to_string(lines[greatest(start_line, 1):end_line], chr(10))) <> content_hash),
    sm AS (SELECT repo_id, path, coalesce(qualified_name, name) AS q, count(*) AS n_same FROM gs GROUP BY ALL)
    SELECT ir.symbol_id, n_direct, n_direct_tests, n_indirect, coalesce(n_possible, 0) AS n_possible, n_files, list_filter([
      CASE WHEN coalesce(language, '') NOT IN ('python', 'javascript', 'typescript', 'cpp', 'c_sharp', 'go') THEN 'calls of this language are not known' END,
      CASE WHEN n_direct >= 5 THEN 'high fan-in' WHEN n_direct > 0 THEN 'direct callers to keep compatible' END, CASE WHEN n_indirect > 0 THEN 'transitive reach' END,
      CASE WHEN NOT tested THEN 'no tests among its callers' END, CASE WHEN len(fx) > 0 THEN 'side effects: ' || array_to_string(fx[1:4], ', ') END,
      CASE WHEN n_same > 1 THEN 'ambiguous ref' END, CASE WHEN stale THEN 'stale copy' END, CASE WHEN n_possible > 0 THEN 'unverified callers' END], lambda x: x IS NOT NULL) AS risks
    FROM ir JOIN gs ON gs.id = ir.symbol_id JOIN sm ON sm.repo_id = gs.repo_id AND sm.path = gs.path AND sm.q = coalesce(gs.qualified_name, gs.name)
    LEFT JOIN po ON po.symbol_id = ir.symbol_id LEFT JOIN ef ON ef.symbol_id = ir.symbol_id LEFT JOIN sl ON sl.symbol_id = ir.symbol_id""",
)
def edit_plan(spark, folder):
    """What a change of each symbol needs: callers, reach, files and risks."""
    impact, s = _impact(spark, folder)
    bodies = base.chunks(spark, folder).where(F.col("chunk_type").isin("function", "method") & F.col("symbol_id").isNotNull())
    effects = bodies.groupBy("symbol_id").agg(F.max(T.hinted(F.col("content"), T.SIDE_EFFECTS)).alias("side_effects"))
    texts = base.texts(spark, folder).withColumn("file_id", F.lower(F.trim("file_id")))
    return K.edit_plan(s, impact, effects, K.stale_symbols(s, texts), tuple(P.CLASS))


@query(
    "graph_view",
    _G.rstrip()
    + f""", rf AS (SELECT id, path || '::' || coalesce(qualified_name, name) AS ref FROM gs), l0 AS (SELECT lower(trim(file_id)) AS file_id, {_LANGUAGE} AS language, string_split(regexp_replace(ltrim(text, chr(65279)), '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM r),
    ln AS (SELECT file_id, language, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS code FROM l0 WHERE language IS NOT NULL),
    im AS (SELECT file_id, count(DISTINCT t) AS n FROM (SELECT file_id, coalesce({_case(P.IMPORT)}, {_case(P.IMPORT_ALONE)}) AS t FROM ln) WHERE t IS NOT NULL GROUP BY 1),
    bs AS (SELECT gs.id, list_sort(list(DISTINCT base)) AS bases FROM (SELECT file_id, line, trim(unnest(string_split({_case(P.BASES)}, ','))) AS base FROM ln WHERE {_case(P.BASES)} IS NOT NULL) b
      JOIN gs ON gs.file_id = b.file_id AND gs.start_line = b.line AND gs.symbol_type = 'class' WHERE base <> '' GROUP BY 1),
    cs AS (SELECT source_id AS id, list_sort(list(ref))[1:10] AS callees, count(*) AS n FROM (SELECT DISTINCT source_id, target_id FROM rc WHERE NOT ambiguous AND source_id <> target_id) x JOIN rf ON rf.id = x.target_id GROUP BY 1),
    cr AS (SELECT target_id AS id, list_sort(list(ref))[1:10] AS callers, count(*) AS n FROM cl JOIN rf ON rf.id = cl.source_id WHERE tier = 'confident' GROUP BY 1),
    po AS (SELECT target_id AS id, count(*) AS n FROM cl WHERE tier = 'possible' GROUP BY 1), ag AS (SELECT source_id AS id, count(*) AS n FROM rc WHERE ambiguous GROUP BY 1),
    mb AS (SELECT k.id, count(*) AS n FROM ns k JOIN ns m ON m.repo_id = k.repo_id AND starts_with(m.qname, k.qname || '.') GROUP BY 1)
    SELECT gs.id AS symbol_id, coalesce(callees, []) AS callees, coalesce(cs.n, 0) AS n_callees, coalesce(ag.n, 0) AS n_ambiguous, coalesce(callers, []) AS callers, coalesce(cr.n, 0) AS n_callers, coalesce(po.n, 0) AS n_possible,
      coalesce(mb.n, 0) AS n_members, coalesce(im.n, 0) AS n_imports, coalesce(bases, []) AS bases
    FROM gs LEFT JOIN cs ON cs.id = gs.id LEFT JOIN cr ON cr.id = gs.id LEFT JOIN po ON po.id = gs.id LEFT JOIN ag ON ag.id = gs.id LEFT JOIN mb ON mb.id = gs.id LEFT JOIN im ON im.file_id = gs.file_id LEFT JOIN bs ON bs.id = gs.id""",
)
def graph_view(spark, folder):
    """What surrounds each symbol: calls, callers, members, imports, bases."""
    r, s = _resolved(spark, folder)
    texts = base.texts(spark, folder).withColumn("file_id", F.lower(F.trim("file_id")))
    heads = s.where("symbol_type = 'class'").select(F.col("id").alias("symbol_id"), "file_id", F.col("start_line").alias("line"))
    bases = P.inherits_edges(texts).join(heads, ["file_id", "line"]).select("symbol_id", "base")
    return G.graph_view(r, G.callers(r, s), s, P.import_edges(texts), bases)


@query(
    "brief_tiers",
    f"""{_W}, {_CARDS}, {_CARRIED}, an AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM tm WHERE is_symbol),
    tw AS (SELECT a.query_id, a.id, a.score, a.terms, b.score AS next FROM an a LEFT JOIN an b ON b.query_id = a.query_id AND b.rn = 2 WHERE a.rn = 1),
    jd AS (SELECT qc.query_id, id, len(asked) AS n, len(list_intersect(list_transform(asked, lambda x: lower(x)), coalesce(terms, []))) / greatest(len(asked), 1) AS cover, score - coalesce(next, 0) AS lead FROM qc LEFT JOIN tw USING (query_id))
    SELECT query_id, id AS anchor_id, CASE WHEN id IS NULL THEN 'none' WHEN n = 0 THEN 'low' WHEN cover >= 0.999 THEN 'high' WHEN cover >= 0.5 AND lead >= 0.10 THEN 'high' WHEN cover >= 0.5 THEN 'medium' ELSE 'low' END AS tier FROM jd""",
)
def brief_tiers(spark, folder):
    """How far the first card of each query that names a symbol may be trusted."""
    anchors = R.top_k(_ranked(spark, folder).where("is_symbol").drop("rank"), 2, [F.desc("score"), F.col("id")])
    return K.brief_tier(anchors, _queries(spark, folder))


@query(
    "logic_map",
    _G.rstrip() + f", {_ASKED}, {_TOKENS}, {_SYMBOL.replace('rn <= 10', 'rn <= 200')} SELECT DISTINCT a.query_id, rc.source_id, rc.target_id FROM rc JOIN sy a ON a.id = rc.source_id JOIN sy b ON b.id = rc.target_id AND b.query_id = a.query_id",
)
def logic_map(spark, folder):
    """Calls between the symbols that a query found."""
    hits = R.symbol_channel(base.symbols(spark, folder), _queries(spark, folder), k=200).withColumnRenamed("id", "symbol_id")
    return K.logic_map(hits, _resolved(spark, folder)[0].where("target_id IS NOT NULL"))


@query(
    "graph_nodes",
    _S
    + """, px AS (SELECT path, array_to_string(string_split(path, '/')[1:d], '/') AS node FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')))) AS d FROM gs))
    SELECT id AS node, 'symbol' AS kind, path AS above, CAST(1 AS BIGINT) AS n_symbols FROM gs
    UNION ALL SELECT node, CASE WHEN bool_or(node = path) THEN 'file' ELSE 'folder' END, nullif(regexp_extract(node, '^(.*)/[^/]*$', 1), ''), count(*) FROM px GROUP BY node""",
)
def graph_nodes(spark, folder):
    """Folders, files and symbols as nested nodes."""
    return K.graph_nodes(base.graph_symbols(spark, folder))


@query(
    "rendered_cards",
    f"""{_W}, {_CARDS}, ls AS (SELECT query_id, rank, rank || '. ' || ref || coalesce(' - ' || left(CASE WHEN strpos(flat, '. ') > 0 THEN left(flat, strpos(flat, '. ')) ELSE flat END, 160), '') AS line
      FROM (SELECT query_id, rank, ref, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS flat FROM ra WHERE rank <= 10)) SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS text FROM ls GROUP BY 1""",
)
def rendered_cards(spark, folder):
    """The first ten cards of each query as text."""
    return K.render_cards(_ranked(spark, folder).where("rank <= 10"))
