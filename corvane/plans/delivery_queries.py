"""Delivery of code by ref, and what an edit breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import changes as C
from corvane.operators import delivery as D
from corvane.operators import graph as G
from corvane.operators import parsing as P
from corvane.plans import base
from corvane.plans.graph_queries import _G, _resolved
from corvane.plans.registry import query
from corvane.plans.source_queries import _LANGUAGE, _case
from corvane.plans.text_queries import _LINES
from corvane.tables import key_of, load

#: How each card is asked for, by its number modulo the list, so that all forms are used.
_FORMS = (("exact", "full"), ("neighbors", "full"), ("parent", "full"), ("file", "head:40"), ("block", "full"), ("exact", "signature"), ("exact", "lines:10-20"), ("exact", "head:3"))


def _cards(spark, folder):
    """Cards with the hints that their symbol left when it was indexed."""
    c = base.chunks(spark, folder).where("ref IS NOT NULL")
    hints = base.symbols(spark, folder).select(F.col("id").alias("symbol_id"), "signature_hash", F.col("content_hash"), "fingerprint")
    named = F.col("chunk_type").isin("function", "method", "class") & F.col("qualified_name").isNotNull()
    q = F.when(named, F.replace("qualified_name", F.lit("::"), F.lit(".")))
    return c.join(hints, "symbol_id", "left").select(
        "id", "repo_id", "path", "ref", q.alias("q"), F.coalesce(F.col("chunk_type") == "file", F.lit(False)).alias("is_file"), "start_line", "end_line",
        "signature_hash", "content_hash", "fingerprint", "is_complete_unit", "unit_kind", "parent_ref",
    )


def _symbols(spark, folder):
    return base.graph_symbols(spark, folder)


_CARDS = f"""WITH {base.SQL}, {base.GRAPH_SQL},
cd AS (SELECT c.id, c.repo_id, c.path, c.ref, CASE WHEN chunk_type IN ('function', 'method', 'class') THEN replace(c.qualified_name, '::', '.') END AS q, coalesce(chunk_type = 'file', false) AS is_file,
    c.start_line, c.end_line, s.signature_hash, s.content_hash, s.fingerprint, is_complete_unit, unit_kind, parent_ref FROM c LEFT JOIN s ON s.id = c.symbol_id WHERE ref IS NOT NULL)"""


@query(
    "completeness",
    _CARDS
    + """ SELECT id, coalesce(is_complete_unit, 1) <> 0 AS safe, CASE WHEN is_complete_unit = 0 THEN parent_ref END AS parent,
      is_complete_unit = 0 AND EXISTS (SELECT 1 FROM cd p WHERE p.repo_id = cd.repo_id AND p.ref = cd.parent_ref) AS upgraded FROM cd""",
)
def completeness(spark, folder):
    """Which cards are whole units, and which are delivered as their parent instead."""
    cards = D.complete_units(_cards(spark, folder))
    parents = cards.select("repo_id", F.col("ref").alias("parent"), F.lit(True).alias("there")).distinct()
    return cards.join(parents, ["repo_id", "parent"], "left").select("id", "safe", "parent", (~F.col("safe") & F.coalesce("there", F.lit(False))).alias("upgraded"))


_FORM = "CASE abs(ascii(right(id, 1)) + ascii(right(id, 2))) % 8 " + " ".join(f"WHEN {k} THEN '{{}}'" for k in range(8)) + " END"


def _form(at: int) -> str:
    return _FORM.format(*[f[at] for f in _FORMS])


@query(
    "ref_delivery",
    _CARDS
    + f""", asked AS (SELECT *, {_form(0)} AS expand, {_form(1)} AS view FROM cd),
    up AS (SELECT repo_id, ref, min(id) AS pid FROM cd GROUP BY 1, 2),
    us AS (SELECT a.id AS asked_id, a.ref AS asked, a.view, CASE WHEN p.id IS NOT NULL THEN 'exact' ELSE a.expand END AS expand, coalesce(p.id, a.id) AS use_id,
        CASE WHEN p.id IS NOT NULL THEN 'auto-expanded from partial block ' || a.ref || ' to complete unit ' || a.parent_ref
             WHEN a.is_complete_unit = 0 THEN 'partial unit (' || coalesce(a.unit_kind, 'None') || ') — not safe to reason from alone' || coalesce(' (parent: ' || a.parent_ref || ')', '') END AS note
      FROM asked a LEFT JOIN up ON a.is_complete_unit = 0 AND a.expand <> 'block' AND up.repo_id = a.repo_id AND up.ref = a.parent_ref LEFT JOIN cd p ON p.id = up.pid),
    rf AS (SELECT us.*, cd.* EXCLUDE (id) FROM us JOIN cd ON cd.id = us.use_id),
    tx AS (SELECT repo_id, path, CASE WHEN length(min(text)) = 0 THEN [] ELSE {_LINES.format(c='min(text)')} END AS lines FROM r GROUP BY 1, 2),
    sy AS (SELECT id AS sid, repo_id, path, replace(qualified_name, '::', '.') AS q, start_line AS a, end_line AS b, signature_hash AS sh, fingerprint AS fp FROM gs),
    nm AS (SELECT rf.asked_id, sy.*, coalesce(sh = signature_hash, false) AS same, row_number() OVER (PARTITION BY rf.asked_id ORDER BY CASE WHEN sh = signature_hash THEN 0 ELSE 1 END, coalesce(abs(a - start_line), a), a, sid) AS rn FROM rf JOIN sy USING (repo_id, path, q)),
    kk AS (SELECT asked_id, count(*) AS k, count(*) FILTER (same) AS k_same, max(a) FILTER (rn = 1) AS a, max(b) FILTER (rn = 1) AS b FROM nm GROUP BY 1),
    bd AS (SELECT repo_id, path, fp, min(a) AS a, min(b) AS b FROM sy WHERE fp IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1),
    rs AS (SELECT rf.*, lines, greatest(len(lines), 1) AS total, coalesce(k > 1 AND k_same <> 1, false) AS ambiguous,
        CASE WHEN q IS NULL AND is_file THEN 'file' WHEN q IS NULL AND start_line IS NOT NULL AND end_line IS NOT NULL THEN 'code' WHEN q IS NOT NULL AND k = 1 THEN 'qname' WHEN q IS NOT NULL AND k > 1 AND k_same = 1 THEN 'signature' WHEN q IS NOT NULL AND k > 1 THEN 'qname'
             WHEN q IS NOT NULL AND bd.a IS NOT NULL THEN 'fingerprint' WHEN q IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL THEN 'line' END AS how, coalesce(kk.a, bd.a, start_line) AS fa, coalesce(kk.b, bd.b, end_line) AS fb
      FROM rf LEFT JOIN kk USING (asked_id) LEFT JOIN bd ON rf.q IS NOT NULL AND bd.repo_id = rf.repo_id AND bd.path = rf.path AND bd.fp = rf.fingerprint LEFT JOIN tx ON tx.repo_id = rf.repo_id AND tx.path = rf.path),
    r1 AS (SELECT *, CASE WHEN how = 'file' THEN 1 ELSE coalesce(fa, 1) END AS f1, CASE WHEN how = 'file' THEN total ELSE coalesce(fb, total) END AS l1, nullif(regexp_extract(q, '^(.*)\\.[^.]*$', 1), '') AS qa FROM rs),
    r2 AS (SELECT r1.*, how = 'line' OR coalesce(how IN ('qname', 'signature') AND sha256(array_to_string(lines[f1:l1], chr(10))) <> content_hash, false) AS stale, expand = 'parent' AND how IN ('qname', 'signature', 'fingerprint') AS tp, ar.a AS pa, ar.b AS pb
      FROM r1 LEFT JOIN (SELECT repo_id, path, q, min((a, b))[1] AS a, min((a, b))[2] AS b FROM sy GROUP BY 1, 2, 3) ar ON ar.repo_id = r1.repo_id AND ar.path = r1.path AND ar.q = r1.qa),
    r3 AS (SELECT *, greatest(1, least(CASE WHEN tp AND qa IS NULL THEN 1 WHEN tp AND pa IS NOT NULL THEN pa ELSE f1 END, total)) AS s1, CASE WHEN tp AND qa IS NULL THEN total WHEN tp AND pa IS NOT NULL THEN pb ELSE l1 END AS e0 FROM r2),
    r4 AS (SELECT *, greatest(s1, least(e0, total)) AS e1 FROM r3),
    r5 AS (SELECT *, CASE expand WHEN 'file' THEN 1 WHEN 'neighbors' THEN greatest(1, s1 - 8) ELSE s1 END AS x, CASE expand WHEN 'file' THEN total WHEN 'neighbors' THEN least(total, e1 + 8) ELSE e1 END AS y FROM r4),
    r6 AS (SELECT *, CASE WHEN view = 'lines:10-20' THEN greatest(x, least(10, y)) ELSE x END AS s,
        CASE WHEN view = 'signature' THEN coalesce(list_min(list_filter(range(x, y + 1), lambda i: contains(lines[i], '{{') OR regexp_matches(lines[i], ':\\s*$'))), x)
             WHEN view LIKE 'head:%' THEN least(y, x + CAST(substr(view, 6) AS INT) - 1) WHEN view = 'lines:10-20' THEN greatest(x, least(20, y)) ELSE y END AS e FROM r5)
    SELECT asked_id, asked, ref, CASE WHEN lines IS NOT NULL THEN how END AS how, CAST(CASE WHEN lines IS NOT NULL AND how IS NOT NULL THEN s END AS INT) AS start_line, CAST(CASE WHEN lines IS NOT NULL AND how IS NOT NULL THEN least(e, s + 1199) END AS INT) AS end_line,
      CASE WHEN lines IS NOT NULL AND how IS NOT NULL THEN stale END AS stale, ambiguous, coalesce(is_complete_unit, 1) <> 0 AS safe, CAST(CASE WHEN lines IS NOT NULL AND how IS NOT NULL THEN greatest(0, e - s + 1 - 1200) END AS INT) AS truncated, note,
      CASE WHEN lines IS NOT NULL AND how IS NOT NULL THEN md5(array_to_string(lines[s:least(e, s + 1199)], chr(10))) END AS code_md5 FROM r6""",
)
def ref_delivery(spark, folder):
    """The code of every card, asked for in each of the forms in turn."""
    turn = (F.ascii(F.right("id", F.lit(1))) + F.ascii(F.right("id", F.lit(2)))) % len(_FORMS)
    form = lambda at: F.element_at(F.array(*[F.lit(f[at]) for f in _FORMS]), turn + 1)
    cards = _cards(spark, folder).withColumns({"expand": form(0), "view": form(1)})
    out = D.deliver(cards, base.texts(spark, folder), _symbols(spark, folder))
    return out.withColumn("code_md5", F.md5(F.col("code").cast("binary"))).drop("code")


_STONES = """ts AS (SELECT DISTINCT kind, lower(trim(key)) AS key FROM tombstones WHERE trim(key) <> ''),
df AS (SELECT DISTINCT repo_id, path FROM f WHERE lower(trim(id)) IN (SELECT key FROM ts WHERE kind = 'file')),
lv AS (SELECT repo_id, path, replace(coalesce(qualified_name, name), '::', '.') AS q, signature_hash AS sh, fingerprint AS fp FROM gs WHERE lower(trim(id)) NOT IN (SELECT key FROM ts WHERE kind = 'symbol')),
od AS (SELECT id, repo_id, path, name, signature_hash AS sh, fingerprint AS fp, replace(coalesce(qualified_name, name), '::', '.') AS q FROM gs),
fa AS (SELECT id AS symbol_id, repo_id, path, name, 'file_deleted' AS fate, NULL::VARCHAR AS now FROM od SEMI JOIN df USING (repo_id, path)
  UNION ALL SELECT id, repo_id, path, name, fate, CASE WHEN fate = 'renamed' THEN moved END FROM (SELECT od.*, moved,
      CASE WHEN NOT EXISTS (SELECT 1 FROM lv WHERE lv.repo_id = od.repo_id AND lv.path = od.path AND lv.q = od.q) THEN CASE WHEN moved IS NOT NULL THEN 'renamed' ELSE 'removed' END
           WHEN od.sh IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.repo_id = od.repo_id AND lv.path = od.path AND lv.q = od.q AND lv.sh = od.sh) THEN 'signature_changed' END AS fate
    FROM od ANTI JOIN df USING (repo_id, path) LEFT JOIN (SELECT repo_id, path, fp, min(q) AS moved FROM lv WHERE fp IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1) bd USING (repo_id, path, fp)) WHERE fate IS NOT NULL)"""


def _fates(spark, folder):
    """Symbols as indexed against those that no tombstone took; every file counts as changed."""
    s = base.graph_symbols(spark, folder)
    stones = load(spark, folder, "tombstones").select("kind", key_of("key").alias("key")).where("key IS NOT NULL").distinct()
    live = s.withColumn("key", key_of("id")).join(stones.where("kind = 'symbol'").select("key"), "key", "left_anti")
    deleted = base.files(spark, folder).withColumn("key", key_of("id")).join(stones.where("kind = 'file'").select("key"), "key", "left_semi").select("repo_id", "path").distinct()
    return C.fates(s, live, s.select("repo_id", "path"), deleted), deleted


@query("fates", f"WITH {base.SQL}, {base.GRAPH_SQL}, {_STONES} SELECT * FROM fa")
def fates(spark, folder):
    """What became of each symbol that is not as it was indexed."""
    return _fates(spark, folder)[0]


@query(
    "breakage",
    _G.rstrip()
    + f", {_STONES} SELECT fa.*, count(*) FILTER (tier = 'confident') AS n_confident, count(*) FILTER (tier = 'possible') AS n_possible FROM fa JOIN cl ON cl.target_id = fa.symbol_id GROUP BY ALL",
)
def breakage(spark, folder):
    """Symbols that were removed, renamed or changed, with the calls that they leave behind."""
    return C.broken_calls(_fates(spark, folder)[0], G.callers(*_resolved(spark, folder)))


_IMPORTED = f"""l0 AS (SELECT file_id, repo_id, path, {_LANGUAGE} AS language, string_split(regexp_replace(ltrim(text, chr(65279)), '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM r),
ln AS (SELECT *, unnest(ls) AS code FROM l0 WHERE language IS NOT NULL),
im AS (SELECT DISTINCT repo_id, path, regexp_extract(regexp_replace(target, '\\.\\w+$', CASE WHEN contains(target, '/') THEN '' ELSE '\\0' END), '[^./]+$') AS name FROM (SELECT repo_id, path, coalesce({_case(P.IMPORT)}, {_case(P.IMPORT_ALONE)}) AS target FROM ln) WHERE target IS NOT NULL)"""


@query(
    "dangling_imports",
    f"""WITH {base.SQL}, {base.GRAPH_SQL}, {_STONES}, {_IMPORTED},
    nm AS (SELECT repo_id, name, min(w) AS w FROM (SELECT repo_id, regexp_extract(regexp_extract(path, '[^/]*$'), '^(.*?)(?:\\.[^.]*)?$', 1) AS name, 1 AS w FROM df
      UNION ALL SELECT repo_id, name, CASE WHEN fate = 'file_deleted' THEN 2 ELSE 3 END FROM fa WHERE fate IN ('file_deleted', 'removed', 'renamed')) GROUP BY 1, 2)
    SELECT DISTINCT repo_id, path AS importer_path, name, ['module or file deleted', 'file of the symbol deleted', 'symbol removed or renamed'][w] AS why FROM im JOIN nm USING (repo_id, name)""",
)
def dangling_imports(spark, folder):
    """Imports of files and symbols that are no longer there."""
    found, deleted = _fates(spark, folder)
    texts = base.texts(spark, folder)
    target = F.when(F.contains("target", F.lit("/")), F.regexp_replace("target", r"\.\w+$", "")).otherwise(F.col("target"))
    imports = P.import_edges(texts).join(texts.select("file_id", "repo_id", "path"), "file_id").select("repo_id", "path", F.regexp_extract(target, r"([^./]+)$", 1).alias("name")).distinct()
    return C.dangling_imports(found, deleted, imports)
