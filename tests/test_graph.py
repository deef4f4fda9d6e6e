from corvane.operators import chunking as C
from corvane.operators import evaluation as E
from corvane.operators import graph as G

SYMBOLS = [
    ("alpha", "fa", "alpha.py", "python", "run", "run", "function", 1, 3, None, None),
    ("beta", "fb", "beta.py", "python", "run", "run", "function", 1, 3, None, None),
    ("Engine", "fe", "engine.py", "python", "Engine", "Engine", "class", 1, 9, None, None),
    ("go", "fe", "engine.py", "python", "go", "Engine.go", "method", 2, 5, None, None),
    ("helper", "fe", "engine.py", "python", "helper", "Engine.helper", "method", 6, 8, None, None),
    ("other", "fx", "x.ts", "typescript", "helper", "helper", "function", 1, 2, None, None),
]


def symbols(spark, rows=SYMBOLS):
    return spark.createDataFrame(
        [("r", *x) for x in rows], "repo_id string, id string, file_id string, path string, language string, name string, qualified_name string, symbol_type string, start_line int, end_line int, signature_hash string, fingerprint string"
    )


def resolved(spark):
    s = symbols(spark)
    bodies = spark.createDataFrame([("go", "def go(self):\n    alpha.run()\n    beta.run()\n    self.helper()\n    if (x): pass"), ("alpha", "def run():\n    helper()"), (None, "x()")], "symbol_id string, content string")
    return G.resolve_calls(G.call_edges(s, bodies), s)


def test_receivers_resolve_apart(spark, rows):
    assert rows(resolved(spark).where("source_id = 'go'"), "target_id", "confidence", "ambiguous", "rule") == [
        ("alpha", 0.8, False, "module"), ("beta", 0.8, False, "module"), ("helper", 0.9, False, "class"),
    ]


def test_no_resolution_across_languages(spark, rows):
    assert rows(resolved(spark).where("source_id = 'alpha'"), "target_id", "rule") == [("helper", "name")]


def test_callers_and_impact(spark, rows):
    c = G.callers(resolved(spark), symbols(spark))
    assert rows(c.where("target_id = 'helper'"), "source_id", "tier") == [("alpha", "confident"), ("go", "confident")]
    assert rows(G.impact(c.where("tier = 'confident'"), symbols(spark).selectExpr("id target_id").where("target_id = 'helper'")), "source_id", "hop") == [("alpha", 1), ("go", 1)]


def test_impact_on_a_cycle(spark, rows):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "target_id string, source_id string")
    got = G.impact(calls, spark.createDataFrame([("a",)], "target_id string"), depth=4)
    assert rows(got, "source_id", "hop") == [("b", 1), ("c", 2), ("d", 3)]


def namesakes(spark):
    """Eight classes with ``size``, two with ``tag``, a caller of both, and the same names elsewhere."""
    rows = [(f"s{k}", f"f{k}", f"c{k}.py", "python", "size", f"C{k}.size", "method", 1, 2, None, None) for k in range(8)]
    rows += [(f"t{k}", f"f{k}", f"c{k}.py", "python", "tag", f"C{k}.tag", "method", 3, 4, None, None) for k in range(2)]
    rows += [("caller", "f9", "use.py", "python", "use", "use", "function", 1, 5, None, None)]
    other = spark.createDataFrame([("q", "z", "fz", "z.py", "python", "tag", "Z.tag", "method", 1, 2, None, None)], symbols(spark, rows).schema)
    s = symbols(spark, rows).unionByName(other)
    bodies = spark.createDataFrame([("caller", "def use(obj):\n    obj.size()\n    obj.tag()")], "symbol_id string, content string")
    return G.resolve_calls(G.call_edges(s, bodies), s), s


def test_common_names_are_suppressed_and_repositories_stay_apart(spark, rows):
    r, s = namesakes(spark)
    assert rows(r, "name", "target_id", "n_candidates", "confidence", "ambiguous", "rule") == [("size", None, 8, 0.35, True, "name"), ("tag", None, 2, 0.35, True, "name")]
    assert rows(G.suppressed_callees(r, s)) == [("caller", 2, 8, 1, ["size"])]
    assert rows(G.callers(r, s), "target_id", "source_id", "tier") == [("t0", "caller", "possible"), ("t1", "caller", "possible")]


def test_self_calls_match_the_whole_class(spark, rows):
    names = [("a", "A.Inner.f"), ("b", "B.Inner.f"), ("g", "B.Inner.g")]
    s = symbols(spark, [(i, "fi", "i.py", "python", q[-1], q, "method", 1, 2, None, None) for i, q in names])
    bodies = spark.createDataFrame([("g", "def g(self):\n    self.f()")], "symbol_id string, content string")
    assert rows(G.resolve_calls(G.call_edges(s, bodies), s), "target_id", "confidence", "rule") == [("b", 0.9, "class")]


def test_members_and_threshold(spark, rows):
    assert rows(G.members(symbols(spark))) == [("Engine", "go"), ("Engine", "helper")]
    deep = symbols(spark, [(i, "f", "a.py", "python", q, q, "class", 1, 2, None, None) for i, q in (("a", "A"), ("b", "A::B"), ("c", "A.B.c"), ("x", "AB.d"))])
    assert rows(G.members(deep)) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert G.collision_threshold(symbols(spark)).first()["threshold"] == 8
    assert G.collision_threshold(symbols(spark).where("id = 'go'")).first()["threshold"] == 1 << 30


def test_gaps(spark, rows):
    text = "\n".join(f"line {k}" for k in range(1, 14))
    files = spark.createDataFrame([("f", text)], "file_id string, text string")
    span = spark.createDataFrame([("f", 6, 7)], "file_id string, start_line int, end_line int")
    assert rows(C.complement_gaps(files, span), "start_line", "end_line") == [(1, 5), (8, 13)]
    five = spark.createDataFrame([("f", "a\nb\nc\nd\ne")], "file_id string, text string")
    assert rows(C.complement_gaps(five, spark.createDataFrame([("f", 2, 3)], span.schema))) == []


def test_windows(spark, rows):
    files = spark.createDataFrame([("f", "\n".join("x" * 1 for _ in range(130))), ("e", ""), ("n", None)], "file_id string, text string")
    assert rows(C.window_chunks(files), "file_id", "start_line", "end_line") == [("f", 1, 60), ("f", 101, 130), ("f", 51, 110)]


def test_refs_follow_the_body(spark, rows):
    s = symbols(spark, [("s1", "f", "a.py", "python", "new", "new", "function", 1, 2, "h", "body")])
    refs = spark.createDataFrame([("a.py::old", "a.py", "old", None, "body"), ("a.py::new", "a.py", "new", None, None), ("a.py::x", "a.py", "x", None, None)], "ref string, path string, qualified_name string, signature_hash string, fingerprint string")
    assert rows(C.resolve_refs(refs, s)) == [("a.py::new", "s1", "unique"), ("a.py::old", "s1", "fingerprint"), ("a.py::x", None, "missing")]


def test_measures(spark):
    results = spark.createDataFrame([("q1", "x", 1), ("q1", "y", 2), ("q2", "z", 1)], "query_id string, id string, rank int")
    gold = spark.createDataFrame([("q1", "y"), ("q2", "w"), ("q3", "v")], "query_id string, id string")
    m = E.retrieval_metrics(results, gold).first()
    assert (m["p_at_1"], round(m["p_at_3"], 3), round(m["mrr"], 3)) == (0.0, 0.333, 0.167)
    base = spark.createDataFrame([("p", 0.5, 1), ("fp", 0.1, -1)], "metric string, base double, direction int")
    now = spark.createDataFrame([("p", 0.4), ("fp", 0.1)], "metric string, value double")
    assert {r["metric"]: r["verdict"] for r in E.gate(now, base).collect()} == {"p": "fail", "fp": "pass"}
