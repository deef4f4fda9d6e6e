"""The library as one object: an index folder and the questions that it answers.

Every method returns a DataFrame and runs nothing until the caller asks for rows. Questions about
single queries take texts; the same operators answer many queries at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import aggregates, changes, compose, delivery, graph, parsing, retrieval
from corvane.operators.orphans import orphan_report, orphans
from corvane.plans import base
from corvane.session import checkpointed
from corvane.sources.scan import scan
from corvane.tables import load


class Index:
    """The tables of a folder: repositories, files, raw_files, symbols, chunks, tombstones.

    With ``repo`` every question is asked of that repository only.
    """

    def __init__(self, spark: SparkSession, folder: str, repo: str | None = None):
        self.spark, self.folder, self.repo = spark, folder, repo

    def _own(self, df: DataFrame) -> DataFrame:
        return df if self.repo is None else df.where(F.col("repo_id") == self.repo)

    def _files(self) -> DataFrame:
        return self._own(base.files(self.spark, self.folder))

    def _texts(self) -> DataFrame:
        return self._own(base.texts(self.spark, self.folder))

    def _symbols(self) -> DataFrame:
        return self._own(base.symbols(self.spark, self.folder))

    def _placed(self) -> DataFrame:
        return self._own(base.graph_symbols(self.spark, self.folder))

    def _chunks(self) -> DataFrame:
        return self._own(base.chunks(self.spark, self.folder))

    def _bodies(self) -> DataFrame:
        return self._chunks().where(F.col("chunk_type").isin("function", "method") & F.col("symbol_id").isNotNull())

    def _queries(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, query string")

    def _resolved(self) -> tuple[DataFrame, DataFrame]:
        s = self._placed()
        return graph.resolve_calls(graph.call_edges(s, self._bodies().select("symbol_id", "content")), s), s

    def scan(self, root: str, rules: list[str] | None = None, max_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
        """Files of a source tree, and those that are too large."""
        return scan(self.spark, root, rules, max_bytes)

    def changed(self, live: DataFrame) -> DataFrame:
        """``path, state`` of ``live(id, path, content_hash)`` against what is indexed."""
        return changes.diff(self._own(load(self.spark, self.folder, "files")).select("id", "path", "content_hash").distinct(), live)

    def search(
        self, *texts: str, k: int = 10, mode: str = "default", channels: tuple[str, ...] = ("symbol", "keyword", "vector"), chunk_types: tuple[str, ...] = ()
    ) -> DataFrame:
        """Cards found by name, words and vectors for each text, merged by the weights of a mode.

        A text that is the whole name of a symbol is answered by that symbol's cards alone, with score 1.
        Prose counts half where code is wanted, cards for the graph only count less. With
        ``chunk_types`` only cards of these types are found.
        """
        return self._search(self._queries(*texts), k, mode, channels, chunk_types)

    def search_assessed(self, *texts: str, k: int = 10, mode: str = "default") -> DataFrame:
        """``search`` with ``confidence``. Where the first cards cluster on one name and a term of the
        text is carried by none of them, each term is searched by itself and the cards of all these
        searches are ordered by the terms that they carry."""
        asked = self._queries(*texts)
        # Few rows that several branches read, so they are written once.
        first = checkpointed(self._search(asked, k, mode))
        trust = checkpointed(retrieval.assess_confidence(first, asked).select("query_id", "confidence"))
        low = asked.join(trust.where("confidence = 'low'"), "query_id", "left_semi")
        if low.isEmpty():
            return first.join(trust, "query_id")
        terms = low.select("query_id", F.explode(T.query_tokens(F.col("query"))).alias("query"))
        terms = terms.select(F.concat("query_id", F.lit(":"), "query").alias("query_id"), "query")
        more = checkpointed(self._search(terms, k, mode)).withColumn("query_id", F.substring_index("query_id", ":", 1))
        again = first.join(low.select("query_id"), "query_id", "left_semi").unionByName(more)
        best = again.withColumn("n", F.row_number().over(W.partitionBy("query_id", "ref").orderBy(F.desc("score"), "id"))).where("n = 1").drop("n")
        fanned = retrieval.rerank_by_coverage(best, low).where(F.col("rank") <= k).drop("blended")
        kept = first.join(low.select("query_id"), "query_id", "left_anti").unionByName(fanned)
        return kept.join(trust, "query_id")

    def _search(
        self, asked: DataFrame, k: int, mode: str, channels: tuple[str, ...] = ("symbol", "keyword", "vector"), chunk_types: tuple[str, ...] = ()
    ) -> DataFrame:
        cards = self._chunks()
        if chunk_types:
            cards = cards.where(F.col("chunk_type").isin(*chunk_types))
        named = self._symbols().select(F.col("id").alias("symbol_id"), "name")
        exact = asked.where(F.col("query").rlike(r"^[A-Za-z_]\w{2,}$") & ~F.lower("query").isin(*T.STOPWORDS)).join(named, F.lower("name") == F.lower("query")).select("query_id", "symbol_id").distinct()
        direct = exact.join(cards.select("id", "symbol_id"), "symbol_id").select("query_id", "id", F.lit(1.0).alias("score"))
        rest = asked.join(exact.select("query_id").distinct(), "query_id", "left_anti")
        parts = {}
        if "symbol" in channels:
            hits = retrieval.symbol_channel(named.withColumnRenamed("symbol_id", "id"), rest, k=k).withColumnRenamed("id", "symbol_id")
            parts["symbol"] = hits.join(cards.select("id", "symbol_id"), "symbol_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
        texts_ = cards.select("id", F.concat_ws(" ", "content", "summary", "path").alias("text"))
        if "keyword" in channels:
            parts["keyword"] = retrieval.bm25(texts_, rest)
        if "vector" in channels:
            wanted = retrieval.hash_embedding(rest.select(F.col("query_id").alias("id"), F.col("query").alias("text"))).withColumnRenamed("id", "query_id")
            parts["vector"] = retrieval.vector_channel(retrieval.hash_embedding(texts_), wanted)
        weights = retrieval.MODES.get(mode, retrieval.MODES["default"])
        merged = retrieval.merge_channels(parts, weights, k=4 * k).select("query_id", "id", "score").unionByName(direct)
        n_lines = F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
        kind = T.content_type(F.col("path"), T.index_language(F.col("path")), F.col("chunk_type"))
        shown = cards.select("id", "symbol_id", "ref", "path", "start_line", "summary", "chunk_type", "content", "qualified_name", kind.alias("content_type"), n_lines.alias("n"))
        shown = shown.withColumn("visibility", T.visibility(F.col("content_type"), F.col("chunk_type"), F.col("n"))).drop("n")
        wants = asked.select("query_id", compose.query_intent(F.col("query")).alias("intent"))
        found = merged.join(shown, "id").join(named, "symbol_id", "left").join(wants, "query_id")
        found = compose.penalize(found).drop("intent", "content_type", "visibility")
        kept = retrieval.collapse_by_ref(
            found.withColumn("ref", F.coalesce("ref", "id")).withColumn("is_complete", F.coalesce(F.col("chunk_type").isin("function", "method"), F.lit(False))).withColumn("is_symbol", F.col("symbol_id").isNotNull())
        )
        return retrieval.top_k(kept, k, [F.desc("score"), F.col("id")])

    def symbol(self, *names: str, k: int = 10) -> DataFrame:
        """Symbols whose name is, begins with or contains one of the names."""
        return retrieval.symbol_channel(self._symbols(), self._queries(*names), k=k)

    def get(self, *refs: str, expand: str = "exact", view: str = "full", neighbors: int = 8, max_lines: int = 1200) -> DataFrame:
        """The code of each ref as it is today, see ``delivery.deliver``; a ref that no card has is looked
        up by its name or lines alone."""
        asked = self.spark.createDataFrame([(r,) for r in dict.fromkeys(refs)], "ref string")
        hints = self._symbols().select(F.col("id").alias("symbol_id"), "signature_hash", "content_hash", "fingerprint")
        cards = self._chunks().where("ref IS NOT NULL").join(hints, "symbol_id", "left")
        one = cards.groupBy("ref").agg(F.min_by(F.struct(*[c for c in cards.columns if c != "ref"]), "id").alias("c"))
        places = self._files().select("repo_id", F.col("path").alias("p")).groupBy("p").agg(F.min("repo_id").alias("r"))
        a, b = T.ref_lines(F.col("ref"))
        known = asked.join(one, "ref", "left").withColumn("p", T.ref_path(F.col("ref"))).join(places, "p", "left")
        q = F.replace(T.ref_name(F.col("ref")), F.lit("::"), F.lit("."))
        rows = known.select(
            F.coalesce("c.id", "ref").alias("id"), F.coalesce("c.repo_id", "r").alias("repo_id"), F.col("p").alias("path"), "ref", q.alias("q"),
            (q.isNull() & a.isNull()).alias("is_file"), F.coalesce(a, "c.start_line").alias("start_line"), F.coalesce(b, "c.end_line").alias("end_line"),
            "c.signature_hash", "c.content_hash", "c.fingerprint", "c.is_complete_unit", "c.unit_kind", "c.parent_ref", F.lit(expand).alias("expand"), F.lit(view).alias("view"),
        )
        # The parents that partial units are delivered as are cards too, but not asked for.
        parents = cards.join(rows.select(F.col("parent_ref").alias("ref")).distinct(), "ref", "left_semi").join(asked, "ref", "left_anti").select(
            "id", "repo_id", "path", "ref", F.replace(T.ref_name(F.col("ref")), F.lit("::"), F.lit(".")).alias("q"), F.lit(False).alias("is_file"), "start_line", "end_line",
            "signature_hash", "content_hash", "fingerprint", "is_complete_unit", "unit_kind", "parent_ref", F.lit(expand).alias("expand"), F.lit(view).alias("view"),
        )
        out = delivery.deliver(rows.unionByName(parents), self._texts(), self._placed(), neighbors, max_lines)
        return out.join(asked.withColumnRenamed("ref", "asked"), "asked", "left_semi").drop("asked_id")

    def view(self) -> DataFrame:
        """What surrounds each symbol: calls, callers, members, imports, bases."""
        r, s = self._resolved()
        texts = self._texts().withColumn("file_id", F.lower(F.trim("file_id")))
        heads = s.where("symbol_type = 'class'").select(F.col("id").alias("symbol_id"), "file_id", F.col("start_line").alias("line"))
        bases = parsing.inherits_edges(texts).join(heads, ["file_id", "line"]).select("symbol_id", "base")
        return graph.graph_view(r, graph.callers(r, s), s, parsing.import_edges(texts), bases)

    def breakage(self, live: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
        """Calls that break if the symbols of the changed files are those of ``live``, see ``changes.fates``."""
        r, s = self._resolved()
        return changes.broken_calls(changes.fates(s, live, changed, deleted), graph.callers(r, s))

    def context(self, task: str, budget: int = 4000, k: int = 40) -> DataFrame:
        """The cards for a task that fit a budget of tokens."""
        return retrieval.token_budget(self.search(task, k=k).withColumn("n_tokens", T.token_count(F.col("content"))), budget)

    def tests(self, target: str, k: int = 10) -> DataFrame:
        """Test files that hold the words of a target, best first."""
        cards = self._chunks().select("id", "path", F.col("content").alias("text"))
        hits = retrieval.bm25(cards, self._queries(target), k=40).join(cards.select("id", "path"), "id").where(T.is_test_path(F.col("path")))
        return hits.groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path").limit(k)

    def callers(self) -> DataFrame:
        """Certain and possible callers of every symbol."""
        return graph.callers(*self._resolved())

    def impact(self, *symbol_ids: str, depth: int = 2) -> DataFrame:
        """Who is affected if one of the symbols changes."""
        targets = self.spark.createDataFrame([(s,) for s in symbol_ids], "target_id string")
        return graph.impact(self.callers().where("tier = 'confident'"), targets, depth)

    def plan(self, depth: int = 3) -> DataFrame:
        """What a change of each symbol needs: callers, reach, files and risks."""
        r, s = self._resolved()
        callers = graph.callers(r, s)
        hops = graph.impact(callers.where("tier = 'confident'"), s.select(F.col("id").alias("target_id")), depth)
        impact = graph.impact_report(hops, callers.where("tier = 'possible'"), s, T.is_test_path)
        effects = self._bodies().groupBy("symbol_id").agg(F.max(T.hinted(F.col("content"), T.SIDE_EFFECTS)).alias("side_effects"))
        texts = self._texts().withColumn("file_id", F.lower(F.trim("file_id")))
        return compose.edit_plan(s, impact, effects, compose.stale_symbols(s, texts), tuple(parsing.CLASS))

    def brief(self, task: str) -> DataFrame:
        """The card to begin a task with, and how far it may be trusted."""
        anchors = retrieval.top_k(self.search(task).where("is_symbol").drop("rank"), 2, [F.desc("score"), F.col("id")])
        return compose.brief_tier(anchors, self._queries(task))

    def map(self, mode: str = "default") -> DataFrame:
        """A map of the corpus: default, architecture, domains, entrypoints or tests; others count as default."""
        f, c = self._files(), self._chunks()
        modes = {
            "architecture": lambda: aggregates.map_architecture(f), "domains": lambda: aggregates.map_domains(c),
            "entrypoints": lambda: aggregates.map_entrypoints(c), "tests": lambda: aggregates.map_tests(f),
        }
        return modes.get(mode, lambda: aggregates.map_default(f))()

    def health(self) -> DataFrame:
        """Files, symbols and chunks of each repository."""
        return aggregates.repo_counts(self._files(), self._symbols(), self._chunks())

    def orphans(self) -> DataFrame:
        """References to records that do not exist, counted by table and month."""
        tables = {n: self._own(load(self.spark, self.folder, n)) for n in ("files", "symbols", "chunks")}
        return orphan_report(orphans(tables, tombstones=load(self.spark, self.folder, "tombstones")))
