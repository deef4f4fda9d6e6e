import hashlib
import math
import re
from collections import Counter
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from corvane.operators import retrieval as R
from corvane.plans import search_queries as S
from corvane.plans.registry import ORACLES
from corvane.tables import SCHEMAS

SCHEMA_OF_CHUNKS = dict(x.split() for x in SCHEMAS["chunks"].split(", "))


def hits(spark, *rows):
    return spark.createDataFrame([("q", i, float(s)) for i, s in rows], "query_id string, id string, score double")


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


def test_merge_symbol_first(spark):
    channels = {"symbol": hits(spark, ("c1", 1.0), ("c2", 0.0)), "keyword": hits(spark, ("c2", 5.0))}
    assert scores(R.merge_channels(channels, R.MODES["default"])) == {"c1": 0.40, "c2": 0.21}


def test_merge_ties_by_id(spark):
    merged = R.merge_channels({"symbol": hits(spark, ("c_b", 0.5), ("c_a", 0.5))}, R.MODES["default"]).orderBy("rank")
    assert [r["id"] for r in merged.collect()] == ["c_a", "c_b"]


def test_single_hit_is_degenerate(spark):
    assert scores(R.merge_channels({"keyword": hits(spark, ("only", 42.0))}, R.MODES["default"])) == {"only": 0.21}


def test_merge_vector_scaled(spark):
    channels = {"symbol": hits(spark, ("c1", 1.0)), "vector": hits(spark, ("c2", 0.95), ("c3", 0.10))}
    assert scores(R.merge_channels(channels, R.MODES["default"])) == {"c1": 0.40, "c2": 0.30, "c3": 0.0}


def test_collapse_prefers_complete(spark):
    cards = spark.createDataFrame(
        [("q", "a", "r", 1.0, False, True, 5), ("q", "b", "r", 1.0, True, True, 9), ("q", "c", "s", 0.5, False, False, 1)],
        "query_id string, id string, ref string, score double, is_complete boolean, is_symbol boolean, start_line int",
    )
    assert sorted(r["id"] for r in R.collapse_by_ref(cards).collect()) == ["b", "c"]


def test_confidence_low_on_cluster_with_missing_term(spark):
    cards = spark.createDataFrame([("q", "size", "return the number of elements", k, 1.0, str(k)) for k in range(1, 6)], "query_id string, name string, summary string, rank int, score double, id string")
    asked = spark.createDataFrame([("q", "cell grid size")], "query_id string, query string")
    row = R.assess_confidence(cards, asked).first()
    assert (row["confidence"], row["clustered_on"], row["missing"]) == ("low", "size", ["cell", "grid"])
    one = spark.createDataFrame([("q", "size")], "query_id string, query string")
    assert R.assess_confidence(cards, one).first()["confidence"] == "high"


def test_coverage_beats_score(spark):
    cards = spark.createDataFrame([("q", "size", "elements", 1.0, str(k)) for k in range(5)] + [("q", "cellSize", "", 0.6, "z")], "query_id string, name string, summary string, score double, id string").selectExpr("*", "1 as rank")
    asked = spark.createDataFrame([("q", "cell size")], "query_id string, query string")
    best = R.rerank_by_coverage(cards, asked).orderBy("rank").first()
    assert best["name"] == "cellSize"


def test_bm25_against_loops(spark):
    docs = {"a": "red green red", "b": "greenish blue", "c": "blue blue green red x", "d": "", "e": None}
    asked = {"q1": "gre red", "q2": "blue", "q3": "zzz"}
    d = spark.createDataFrame(list(docs.items()), "id string, text string")
    q = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in R.bm25(d, q, k=50).collect()}
    words = {i: (t or "").split() for i, t in docs.items()}
    avg, want = sum(map(len, words.values())) / len(words), Counter()
    for qid, text in asked.items():
        for p in text.split():
            tf = {i: sum(w.startswith(p) for w in ws) for i, ws in words.items()}
            df = sum(n > 0 for n in tf.values())
            idf = max(math.log((len(words) - df + 0.5) / (df + 0.5)), 1e-6)
            for i, n in tf.items():
                if n:
                    want[qid, i] += idf * n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * len(words[i]) / avg))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_budget_stops(spark):
    cards = spark.createDataFrame([("q", k, 100) for k in range(1, 6)], "query_id string, rank int, n_tokens int")
    assert R.token_budget(cards, 520).count() == 3


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.9])], "id int, vector array<float>")
    near = R.vector_channel(v, v.where("id = 1").withColumnRenamed("id", "query_id"), k=1, exclude_self=True).first()
    assert near["id"] == 3


def test_hybrid_modes_against_loops(spark, tmp_path):
    docs = [(100, "alpha beta gamma", "alpha plan"), (200, "delta epsilon", "delta"), *((k, f"word{k} filler of row {k % 3}", None if k % 2 else f"alpha {k}") for k in range(1, 31))]
    spark.createDataFrame([(i, t, n, "s") for i, t, n in docs], "doc_id bigint, text string, title string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = {i: n for i, t, n in docs if i % 100 == 0}

    def vector(text):
        out = [0.0] * 64
        for w in re.findall("[a-z0-9_]+", text.lower()):
            out[int(hashlib.md5(w.encode()).hexdigest()[-8:], 16) % 64] += 1
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out]

    q = spark.createDataFrame(list(asked.items()), "query_id bigint, query string")
    d = spark.createDataFrame(docs, "id bigint, text string, name string")
    value = {name: {} for name in ("symbol", "keyword", "vector")}
    for r in R.symbol_channel(d.where("name IS NOT NULL"), q).collect():
        value["symbol"].setdefault(r["query_id"], {})[r["id"]] = r["score"]
    for r in R.bm25(d, q).collect():
        value["keyword"].setdefault(r["query_id"], {})[r["id"]] = r["score"]
    for i, text in asked.items():
        near = sorted((round(sum((x - y) ** 2 for x, y in zip(vector(t), vector(text))), 6), j) for j, t, _ in docs)[:20]
        value["vector"][i] = {j: -s for s, j in near}
    want = {}
    for mode, weights in R.MODES.items():
        for i in asked:
            total = Counter()
            for name, hits in value.items():
                own = hits.get(i, {})
                low, high = min(own.values(), default=0), max(own.values(), default=0)
                for j, s in own.items():
                    total[j] += weights[name] * (s if name == "symbol" else 0.7 if high - low < 1e-9 else (s - low) / (high - low))
            for j, s in sorted(total.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10]:
                want[mode, i, j] = s
    got = {(r["mode"], r["query_id"], r["id"]): r["score"] for r in S.hybrid_modes(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_query_of_an_untitled_document_is_its_whole_text(spark, tmp_path):
    docs = [(100, "filler " * 20 + "zebra", None), (200, "zebra", "a title"), (300, None, None), (1, "the zebra crossing", None)]
    spark.createDataFrame([(*d, "s") for d in docs], "doc_id bigint, text string, title string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["query_id"]: r["query"] for r in S._queries(spark, str(tmp_path)).collect()} == {100: docs[0][1], 200: "a title", 300: None}
    assert 1 in [r["id"] for r in S.bm25_topk(spark, str(tmp_path)).where("query_id = 100").collect()]


def test_contained_without_a_nested_loop(spark, rows):
    names = spark.createDataFrame([(1, "get_cell_size"), (2, "ab"), (3, None), (4, "cellcell")], "id int, name string")
    tokens = spark.createDataFrame([("cell",), ("size",), ("get_cell_size",), ("ab",), (None,), ("zzz",)], "token string")
    assert rows(R.contained(names, tokens), "id", "token") == [(1, "cell"), (1, "get_cell_size"), (1, "size"), (4, "cell")]


def test_vectors_in_blocks_of_queries(spark, rows):
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)] + [(99, None)], "id int, vector array<double>")
    q = v.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    whole = rows(R.vector_channel(v, q, k=4))
    assert rows(R.vector_channel(v.repartition(5), q, k=4, block=3)) == whole and len(whole) == 80
    assert R.vector_channel(v, q.limit(0)).count() == 0


def test_spread(spark):
    from corvane.session import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(10, numPartitions=cores + 1)).rdd.getNumPartitions() == cores + 1
    grouped = spark.range(10).groupBy("id").count()
    assert spread(grouped) is grouped


def test_bm25_of_repeated_ids_in_blocks(spark, tmp_path, rows):
    docs = [(k, f"w{k % 7} Straße w{k % 5} shared" + " x" * (k % 4), None if k % 200 else "shared w1 stra") for k in range(100, 700, 20)]
    docs += [(100, "w1 again longer shared", None), (100, "É w1", None), (None, "shared w2", None), (None, "shared", None), (101, None, None)]
    spark.createDataFrame([(*d, "s") for d in docs], "doc_id bigint, text string, title string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    views = duckdb.connect()
    views.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(((q, i, round(s, 6)) for q, i, s in views.sql(ORACLES["bm25_topk"]).fetchall()), key=str)
    assert [(q, i, round(s, 6)) for q, i, s in rows(S.bm25_topk(spark, str(tmp_path)), "query_id", "id", "score")] == want
    d, q = S._documents(spark, str(tmp_path)), S._queries(spark, str(tmp_path))
    rounded = [F.round("score", 6).alias("score")]
    whole = rows(R.bm25(d, q, k=3), "query_id", "id", *rounded)
    assert rows(R.bm25(d.repartition(5), q, k=3, block=2), "query_id", "id", *rounded) == whole and len(whole) == 18


def test_bm25_shuffles_neither_terms_nor_pairs(spark, folder):
    plan = S.bm25_topk(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_titles_where_they_lie(spark, rows):
    titles = [(k, ("cell", "cells", "a cell", "x" * (k % 3), "Grid of\ncells", None)[k % 6]) for k in range(80)] + [(3, "cell"), (3, "grid"), (None, "cell"), (None, "grid")]
    d = spark.createDataFrame(titles, "id int, name string").repartition(5)
    q = spark.createDataFrame([(k, ("the cell", "grid of cells", "zzz", None, "Cells xx")[k % 5]) for k in range(12)], "query_id int, query string")
    want = rows(R.symbol_channel(d.where("id IS NOT NULL AND name IS NOT NULL"), q, k=7))
    assert rows(R.title_channel(d, q, k=7)) == want and len(want) > 40
    assert rows(R.title_channel(d, q, k=7, block=2)) == want


def test_hybrid_shuffles_neither_words_nor_pairs(spark, folder):
    plan = S.hybrid_modes(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate explode(gram" not in plan and plan.count("Generate") == 1  # that of the modes


def test_find_tests_moves_no_text(spark, folder, tmp_path):
    plan = S.find_tests(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Generate" not in plan
    rows = [(f"c{k % 25}", ("tests/a.py", "src/a.py")[k % 2], f"word{k % 3} rest", None, datetime(2024, 1, 1 + k % 28)) for k in range(28)]
    chunks = spark.createDataFrame(rows, "id string, path string, content string, summary string, indexed_at timestamp_ntz")
    for c, kind in SCHEMA_OF_CHUNKS.items():
        chunks = chunks if c in chunks.columns else chunks.withColumn(c, F.lit(None).cast(kind))
    chunks.write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(100, "word1", None, "s"), (200, "word2 rest", None, "s")], "doc_id bigint, text string, title string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    views = duckdb.connect()
    for name in ("files", "raw_files", "symbols"):
        views.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("documents", "chunks"):
        views.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted((q, p, round(s, 6)) for q, p, s in views.sql(ORACLES["find_tests"]).fetchall())
    got = S.find_tests(spark, str(tmp_path))
    assert sorted((r["query_id"], r["path"], round(r["score"], 6)) for r in got.collect()) == want and len(want) == 2


def test_hybrid_topk_shuffles_neither_words_nor_pairs(spark, folder):
    plan = S.hybrid_topk(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1  # that with the titles of the hits


def test_hybrid_topk_makes_vectors_where_they_are_matched(spark, folder):
    plan = S.hybrid_topk(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 3 and "ArrowEvalPython" not in plan


def test_hashed_words_against_their_vectors(spark, rows):
    texts = [(k, f"Word{k % 7} of_row {k % 3}" + " Straße" * (k % 2)) for k in range(60)] + [(5, "again word1"), (70, " - "), (71, None)]
    d = spark.createDataFrame(texts, "id int, text string").repartition(5)
    q = spark.createDataFrame([(k, ("word1 row", "of_row 2", "--", None, "Straße word3")[k % 5]) for k in range(12)], "query_id int, query string")
    wanted = R.hash_embedding(q.selectExpr("query_id AS id", "query AS text")).withColumnRenamed("id", "query_id")
    want = rows(R.vector_channel(R.hash_embedding(d), wanted, k=7))
    assert rows(R.hashed_channel(d, q, k=7)) == want and len(want) == 7 * 8
    assert rows(R.hashed_channel(d, q, k=7, block=2)) == want


def test_prefix_counts_in_bins_and_sorted():
    words = ["red Green red", "greenish\nblue red x", "", "zzz"]
    want = [(0, 0, 1), (0, 1, 1), (1, 0, 2), (1, 1, 1)]
    for more in (0, 10_000):  # so many prefixes are too many for bins
        prefix, doc, tf, sizes = R._term_counts(words, [1, 2, 1, 1], R._Beginnings(["gre", "r", *map(str, range(more))]))
        assert list(zip(prefix, doc, tf)) == want and sizes == [[3], [1, 3], [0], [1]]
