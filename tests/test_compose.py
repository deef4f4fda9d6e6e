import datetime as dt

from corvane.api import Index
from corvane.operators import compose as K


def test_overlaps(spark, rows):
    hits = spark.createDataFrame(
        [("q", "a", "p", 1, 5, False, 1.0), ("q", "b", "p", 4, 9, False, 0.9), ("q", "c", "p", 10, 12, False, 0.8), ("q", "d", "p", 1, 99, True, 0.5)],
        "query_id string, id string, path string, start_line int, end_line int, is_file boolean, score double",
    )
    assert rows(K.overlap_dedup(hits), "id") == [("a",), ("c",), ("d",)]


def test_penalties_and_intent(spark, rows):
    df = spark.createDataFrame([("a", 1.0, "prose", "full", "how does it work"), ("b", 1.0, "code", "graph_only", "cli"), ("c", 1.0, "code", "full", None)], "id string, score double, content_type string, visibility string, q string")
    with_intent = df.withColumn("intent", K.query_intent(df.q))
    assert rows(K.penalize(with_intent), "id", "intent", "score") == [("a", "code", 0.5), ("b", "entrypoint", 0.4), ("c", "mixed", 1.0)]


def test_enrichment_and_effects(spark, rows):
    cards = spark.createDataFrame([("r1", "own", "t"), ("r2", "own", "t")], "ref string, summary string, tags string")
    cache = spark.createDataFrame([("r1", "new", "u"), ("r2", " ", None)], cards.schema)
    assert rows(K.enrich(cards, cache)) == [("r1", "new", "u"), ("r2", "own", "t")]
    shards = spark.createDataFrame([("r1", "r2", None, "e"), ("r1", "r1", 0.9, "e"), ("r1", "zz", 0.9, "e"), (None, "r1", 0.9, "e")], "source string, target string, confidence double, evidence string")
    assert rows(K.affects_edges(shards, cards), "source", "target", "confidence") == [("r1", "r2", 0.5)]


def test_index(spark, folder):
    index = Index(spark, folder)
    name = index.symbol("load").first()
    assert name is None or name["score"] in (1.0, 0.7, 0.4)
    assert index.search("refresh the cache", k=5).count() <= 5
    assert index.map("tests").count() > 0 and index.map("nonsense").count() > 0 and index.health().count() > 0
    ref = spark.read.parquet(f"{folder}/chunks.parquet").where("chunk_type = 'function' and ref like '%::%'").first()["ref"]
    got = {r["asked"]: r for r in index.get(ref, "no/such.py::thing", ref.split("::")[0] + ":2-3").collect()}
    assert set(got) == {ref, "no/such.py::thing", ref.split("::")[0] + ":2-3"} and got["no/such.py::thing"]["code"] is None
    assert got[ref.split("::")[0] + ":2-3"]["how"] == "code" and got[ref]["how"] in ("qname", "signature", "fingerprint", "line", None)
    short = index.get(ref, view="signature").first()
    assert short["code"] is None or len(short["code"]) <= len(got[ref]["code"])
    assert index.context("refresh the cache", k=5).count() <= 5


def test_index_of_one_repository(spark, folder):
    repo = spark.read.parquet(f"{folder}/symbols.parquet").first()["repo_id"]
    index = Index(spark, folder, repo)
    assert [r["repo_id"] for r in index.health().collect()] == [repo]
    found = index.search("refresh the cache", k=5, chunk_types=("function", "method"))
    assert {r["chunk_type"] for r in found.collect()} <= {"function", "method"}


def test_fan_out_brings_back_a_buried_term(spark, tmp_path):
    """Six cards named size bury the one that carries cell; searched term by term it comes first."""
    from corvane.tables import SCHEMAS

    names = [("s%d" % k, "size") for k in range(6)] + [("c", "cellSize")]
    at = dt.datetime(2025, 1, 1)
    symbols = [(i, "r", "f", "method", n, f"C{i}.{n}", None, 1, 2, None, None, None, None, None, at) for i, n in names]
    chunks = [
        ("k" + i, "r", "f", i, "method", "python", f"p{i}.py", 1, 2, "def size(self): return self.n", "return the number of elements" if n == "size" else "grid scale of one cell", None, f"p{i}.py::C{i}.{n}",
         None, f"C{i}.{n}", None, None, 1, None, None, at) for i, n in names
    ]
    files = [("f", "r", "a.py", None, None, None, None, None, None, None)]
    for name, rows in {"symbols": symbols, "chunks": chunks, "files": files}.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    index = Index(spark, str(tmp_path))
    plain = index.search("size number elements grid", k=6, channels=("symbol",)).orderBy("rank").collect()
    assert {r["name"] for r in plain[:5]} == {"size"}
    first = index.search_assessed("size number elements grid", k=6).orderBy("rank").first()
    assert first["confidence"] in ("high", "low")
