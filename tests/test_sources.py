from corvane.operators import changes as Ch
from corvane.operators import parsing as P
from corvane.sources import scan as S
from corvane.streaming import incremental as I
from corvane.tables import SCHEMAS


def test_scan_ignores_and_sets_large_aside(spark, tmp_path, rows):
    for name, text in {"a/x.py": b"x = 1\n", "a/big.py": b"#" * 500, "node_modules/y.js": b"1", "b/z.bin": b"1", "b/n.py": b"a\0b", "gen/g.py": b"1", "b/k.log.py": b"2"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    files, large = S.scan(spark, str(tmp_path), ["gen/", "*.log.py", "# note"], max_bytes=100)
    assert rows(files, "path", "language", "text") == [("a/x.py", "python", "x = 1\n")]
    for name, text in {"secrets/s.py": b"1", "a/bad.py": b"x = '\xff'\n", "keep/build/k.py": b"1", "lib.egg-info/i.py": b"1", ".gitignore": b"# rules\n/big.py\n!a/\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    files, _ = S.scan(spark, str(tmp_path))
    assert rows(files, "path", "text") == [("a/bad.py", "x = '\ufffd'\n"), ("a/x.py", "x = 1\n"), ("b/k.log.py", "2"), ("gen/g.py", "1")]
    assert rows(large) == [("a/big.py", 500)]


def test_log_round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    S.append_log(spark.createDataFrame([(1, "search")], "id long, tool string"), path)
    S.append_log(spark.createDataFrame([(2, "get")], "id long, tool string"), path)
    (tmp_path / "log" / "part-bad.json").write_text("not json\n")
    assert rows(S.read_log(spark, path, "id long, tool string")) == [(1, "search"), (2, "get")]


def test_declarations(spark, rows):
    py = "import os\nclass A(B, C):\n    def f(self):\n        return 1\n\n    def g(self): pass\n\nx = 1\n"
    cs = "using X.Y;\nnamespace N\n{\n    public class K : Base\n    {\n        public int F()\n        {\n            return 1;\n        }\n    }\n}\n"
    files = spark.createDataFrame([("p", "a.py", py), ("c", "a.cs", cs), ("m", "a.md", "class X"), ("n", "b.py", None)], "file_id string, path string, text string")
    assert rows(P.declarations(files), "file_id", "line", "end_line", "kind", "name") == [
        ("c", 4, 10, "class", "K"), ("c", 6, 9, "function", "F"), ("p", 2, 6, "class", "A"), ("p", 3, 4, "function", "f"), ("p", 6, 6, "function", "g"),
    ]
    assert rows(P.inherits_edges(files), "file_id", "base") == [("c", "Base"), ("p", "B"), ("p", "C")]
    assert rows(P.import_edges(files)) == [("c", "X.Y"), ("p", "os")]
    deep = "\n".join(" " * 2 * k + f"def f{k}():" for k in range(40)) + "\n" + " " * 80 + "pass\nx = 1\n"
    nested = P.declarations(spark.createDataFrame([("d", "d.py", deep)], "file_id string, path string, text string"))
    assert {r["end_line"] for r in nested.collect()} == {41} and nested.count() == 40


def test_markup(spark, rows):
    pages = spark.createDataFrame([("h", "<div>\n<p class='a' id=\"main\">x</p>")], "id string, html string")
    assert rows(P.html_elements(pages), "line", "name", "signature") == [(2, "#main", '<p id="main">')]
    sheets = spark.createDataFrame([("s", ".box ,\n a { x: 1 } /* no { */ b{}")], "id string, css string")
    assert rows(P.css_rules(sheets), "ordinal", "name") == [(0, ".box , a"), (1, "b")]


def test_index_stream_skips_what_is_stored(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    row = lambda i, t: (i, "r", f"{i}.py", t)
    spark.createDataFrame([row("a", "1"), row("b", "2"), row("b", "2")], SCHEMAS["raw_files"]).write.parquet(source)
    I.index_stream(spark, source, target, state).awaitTermination()
    spark.createDataFrame([row("a", "1"), row("b", "3")], SCHEMAS["raw_files"]).write.mode("append").parquet(source)
    I.index_stream(spark, source, target, state).awaitTermination()
    assert sorted((r["file_id"], r["text"]) for r in spark.read.parquet(target).collect()) == [("a", "1"), ("b", "2"), ("b", "3")]


def test_usage_stream(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "ts timestamp_ntz, event_type string, value double"
    spark.sql("select timestamp_ntz'2025-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp_ntz'2025-01-01 00:20:00', 'a', 2.0D union all select timestamp_ntz'2025-01-02 00:20:00', 'b', 2.0D").write.parquet(source)
    I.usage_stream(spark, source, schema, target, state).awaitTermination()
    assert [(r["event_type"], r["calls"], r["ms"]) for r in spark.read.parquet(target).collect()] == [("a", 2, 3.0)]


def test_diff_and_upsert(spark, rows):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z")], "id string, path string, content_hash string")
    new = spark.createDataFrame([("1", "a", "x"), ("2", "b", "q"), ("4", "d", "n")], old.schema)
    assert rows(Ch.diff(old, new)) == [("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")]
    assert rows(Ch.upsert(old, new), "id", "content_hash") == [("1", "x"), ("2", "q"), ("3", "z"), ("4", "n")]


def test_cascade_reaches_all_that_hangs_on_it(spark, rows):
    symbols = spark.createDataFrame([("S1", "f1"), ("s2", "f2"), ("s3", "f2"), ("s4", None)], "id string, file_id string")
    chunks = spark.createDataFrame(
        [("c1", "f9", "s1"), ("c2", " F1 ", None), ("c3", "f2", "s2"), ("c4", "f2", "s3"), ("c5", None, None), ("c6", "f1", "s4")], "id string, file_id string, symbol_id string"
    )
    gone = spark.createDataFrame([("file", "F1"), ("symbol", "s2 "), ("file", None)], "kind string, key string")
    # s1 goes with f1 and s2 by itself; c1 with s1, c2 and c6 with f1, c3 with s2
    assert rows(Ch.cascade_delete(symbols, chunks, gone)) == [("chunks", 2), ("symbols", 2)]
