"""What is put together from search, graph and change tracking: risks, tiers, plans, graph data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.retrieval import result_terms

#: Hints of what a query is after, in the order in which they are tried.
INTENTS = {
    "entrypoint": ("cli", "command", "endpoint", "route", "handler", "mcp", "api", "subcommand"),
    "prose": ("docs", "documentation", "readme", "overview", "design", "rationale", "guide", "explain"),
    "code": (
        "implemented", "built", "generated", "detect", "computed", "logic", "algorithm", "how does", "how are", "where is",
        "where does", "function", "class", "method",
    ),
}


def query_intent(query: Column) -> Column:
    """entrypoint, prose, code or mixed, by the first kind of hint that occurs."""
    low, out = F.lower(F.coalesce(query, F.lit(""))), None
    for intent, hints in INTENTS.items():
        hit = T.any_of(low, hints)
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise("mixed")


def penalize(cards: DataFrame, intent: str = "intent") -> DataFrame:
    """Cards with their score halved for prose where code is wanted and cut to 0.4 where the card is
    for the graph only. ``cards`` has ``score, content_type, visibility`` and the intent."""
    factor = F.when((F.col(intent) == "code") & (F.col("content_type") == "prose"), 0.5).otherwise(1.0) * F.when(F.col("visibility") == "graph_only", 0.4).otherwise(1.0)
    return cards.withColumn("score", F.round(F.col("score") * factor, 4))


def overlap_dedup(hits: DataFrame) -> DataFrame:
    """The hits of each query of which none overlaps a better one that is kept.

    ``hits`` has ``query_id, path, start_line, end_line, is_file, score, id``. Greedy by score within
    a query, path and kind; such a group holds the few hits of one query in one file.
    """
    schema = hits.schema

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        rows = []
        for row in group.sort_values(["score", "id"], ascending=[False, True], kind="stable").itertuples():
            if all(row.end_line < a or b < row.start_line for a, b in kept):
                kept.append((row.start_line, row.end_line))
                rows.append(row.Index)
        return group.loc[rows]

    return hits.groupBy("query_id", "path", "is_file").applyInPandas(keep, schema)


def edit_risks(symbols: DataFrame, callers: DataFrame, effects: DataFrame, tested: DataFrame, fan_in: int = 5) -> DataFrame:
    """``symbol_id, n_callers, n_possible, risks``: why a change of a symbol needs care.

    ``effects`` has ``symbol_id, side_effects``, ``tested`` the ``target_id`` that a test calls.
    """
    by = callers.groupBy(F.col("target_id").alias("symbol_id")).agg(F.count_if(F.col("tier") == "confident").alias("n_callers"), F.count_if(F.col("tier") == "possible").alias("n_possible"))
    has_test = tested.select(F.col("target_id").alias("symbol_id")).distinct().withColumn("t", F.lit(True))
    joined = symbols.select(F.col("id").alias("symbol_id")).join(by, "symbol_id", "left").join(effects, "symbol_id", "left").join(has_test, "symbol_id", "left")
    n, p = F.coalesce("n_callers", F.lit(0)), F.coalesce("n_possible", F.lit(0))
    risks = F.filter(
        F.array(
            F.when(n >= fan_in, F.lit("high fan-in")),
            F.when(p > 0, F.lit("unverified callers")),
            F.when(F.size(F.coalesce("side_effects", F.array().cast("array<string>"))) > 0, F.lit("side effects")),
            F.when((n > 0) & F.col("t").isNull(), F.lit("no test calls it")),
        ),
        lambda x: x.isNotNull(),
    )
    return joined.select("symbol_id", n.cast("bigint").alias("n_callers"), p.cast("bigint").alias("n_possible"), risks.alias("risks"))


#: From how many direct callers on a change is widely felt.
HIGH_FAN_IN = 5


def stale_symbols(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """``symbol_id`` of symbols whose lines differ from the hash that was stored when they were indexed."""
    lines = texts.select("file_id", T.lines_of(F.col("text")).alias("lines"))
    now = F.sha2(T.line_slice(F.col("lines"), F.greatest(F.col("start_line"), F.lit(1)), F.col("end_line")), 256)
    return symbols.where("content_hash IS NOT NULL").join(lines, "file_id").where(now != F.col("content_hash")).select(F.col("id").alias("symbol_id"))


def edit_plan(symbols: DataFrame, impact: DataFrame, effects: DataFrame, stale: DataFrame, covered: tuple[str, ...]) -> DataFrame:
    """What a change of each symbol needs: the columns of ``graph.impact_report`` and ``risks``.

    ``effects`` has ``symbol_id, side_effects``, ``stale`` the ``symbol_id`` of symbols whose text is not
    as it was indexed; ``covered`` are the languages whose calls are known. A name that several
    symbols of one file bear makes a ref to it ambiguous.
    """
    named = symbols.select(F.col("id").alias("symbol_id"), "repo_id", "path", "language", F.coalesce("qualified_name", "name").alias("q"))
    shared = named.groupBy("repo_id", "path", "q").agg(F.count(F.lit(1)).alias("n_same"))
    j = named.join(shared, ["repo_id", "path", "q"]).join(impact, "symbol_id").join(effects, "symbol_id", "left").join(stale.distinct().withColumn("stale", F.lit(True)), "symbol_id", "left")
    tags = F.coalesce("side_effects", F.array().cast("array<string>"))
    risks = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("language").isin(*covered), F.lit(False)), F.lit("calls of this language are not known")),
            F.when(F.col("n_direct") >= HIGH_FAN_IN, F.lit("high fan-in")).when(F.col("n_direct") > 0, F.lit("direct callers to keep compatible")),
            F.when(F.col("n_indirect") > 0, F.lit("transitive reach")),
            F.when(~F.col("tested"), F.lit("no tests among its callers")),
            F.when(F.size(tags) > 0, F.concat(F.lit("side effects: "), F.array_join(F.slice(tags, 1, 4), ", "))),
            F.when(F.col("n_same") > 1, F.lit("ambiguous ref")),
            F.when(F.col("stale"), F.lit("stale copy")),
            F.when(F.col("n_possible") > 0, F.lit("unverified callers")),
        )
    )
    return j.select("symbol_id", "n_direct", "n_direct_tests", "n_indirect", "n_possible", "n_files", risks.alias("risks"))


def brief_tier(cards: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, anchor_id, tier``: how far the first anchorable card may be trusted.

    none without such a card; high if it carries all terms of the query or at least half of them with
    a lead in score of 0.10 over the next; medium if it carries half; else low. ``cards`` has
    ``query_id, id, name, summary, score, rank`` of anchorable cards.
    """
    asked = queries.select("query_id", F.transform(T.query_tokens(F.col("query")), F.lower).alias("asked"))
    two = cards.where("rank <= 2").groupBy("query_id").agg(
        F.min_by(F.struct("id", "score", result_terms(cards).alias("terms")), "rank").alias("a"), F.min("score").alias("next"), F.count(F.lit(1)).alias("n")
    )
    joined = asked.join(two, "query_id", "left")
    cover = F.size(F.array_intersect("asked", F.coalesce("a.terms", F.array().cast("array<string>")))) / F.greatest(F.size("asked"), F.lit(1))
    lead = F.col("a.score") - F.when(F.col("n") > 1, F.col("next")).otherwise(F.lit(0.0))
    tier = F.when(F.col("a").isNull(), "none").when(F.size("asked") == 0, "low").when(cover >= 0.999, "high").when((cover >= 0.5) & (lead >= 0.10), "high").when(cover >= 0.5, "medium").otherwise("low")
    return joined.select("query_id", F.col("a.id").alias("anchor_id"), tier.alias("tier"))


def logic_map(hits: DataFrame, calls: DataFrame) -> DataFrame:
    """``query_id, source_id, target_id``: calls between the symbols that a query found."""
    s = hits.select("query_id", F.col("symbol_id").alias("source_id")).distinct()
    t = hits.select("query_id", F.col("symbol_id").alias("target_id")).distinct()
    return s.join(calls.select("source_id", "target_id").distinct(), "source_id").join(t, ["query_id", "target_id"]).select("query_id", "source_id", "target_id")


def graph_nodes(symbols: DataFrame, min_degree: int = 0, degrees: DataFrame | None = None) -> DataFrame:
    """``node, kind, above, n_symbols``: folders, files and symbols as nested nodes, each with its container.

    Symbols with a smaller degree than ``min_degree`` are left out, containers are kept.
    """
    if degrees is not None and min_degree > 0:
        symbols = symbols.join(degrees.where(F.col("degree") >= min_degree).select("id"), "id", "left_semi")
    leaf = symbols.select(F.col("id").alias("node"), F.lit("symbol").alias("kind"), F.col("path").alias("above"), F.lit(1).cast("bigint").alias("n_symbols"))
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    prefixes = symbols.select("path", F.explode(F.transform(depths, lambda d: F.array_join(F.slice(parts, 1, d), "/"))).alias("node"))
    inner = prefixes.groupBy("node").agg(F.max((F.col("node") == F.col("path")).cast("int")).alias("is_file"), F.count(F.lit(1)).alias("n_symbols"))
    above = F.nullif(F.regexp_extract("node", r"^(.*)/[^/]*$", 1), F.lit(""))
    return leaf.unionByName(inner.select("node", F.when(F.col("is_file") == 1, "file").otherwise("folder").alias("kind"), above.alias("above"), "n_symbols"))


def enrich(cards: DataFrame, cache: DataFrame) -> DataFrame:
    """Cards with summary and tags of a cache put in place of their own where it has any.

    ``cache`` has ``ref, summary, tags``; of several rows for one ref one is taken.
    """
    one = cache.groupBy("ref").agg(F.max(F.struct("summary", "tags")).alias("e"))
    joined = cards.join(one, "ref", "left")
    summary = F.when(F.length(F.trim("e.summary")) > 0, F.col("e.summary")).otherwise(F.col("summary"))
    return joined.withColumn("summary", summary).withColumn("tags", F.coalesce("e.tags", "tags")).drop("e")


def affects_edges(shards: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges of effect from lists of ``source, target, confidence, evidence``: those with both ends
    known and different, each once, with the hash of what they say."""
    known = refs.select("ref").distinct()
    rows = shards.where("source IS NOT NULL AND target IS NOT NULL AND source != target")
    rows = rows.join(known.withColumnRenamed("ref", "source"), "source", "left_semi").join(known.withColumnRenamed("ref", "target"), "target", "left_semi")
    return rows.groupBy("source", "target").agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"), F.max("evidence").alias("evidence")).withColumn(
        "evidence_hash", F.sha2(F.concat_ws("|", "source", "target"), 256)
    )


def render_cards(cards: DataFrame) -> DataFrame:
    """``query_id, text``: the cards of each query as lines in their order."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("ref"), F.coalesce(F.concat(F.lit(" - "), T.first_sentence(F.col("summary"))), F.lit("")))
    rows = cards.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
