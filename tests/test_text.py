import hashlib

from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def test_terms(spark):
    assert one(spark, "cellSize", T.terms_of) == ["cell", "size"]
    assert one(spark, "get_cell_size", T.terms_of) == ["cell", "get", "size"]
    assert one(spark, None, T.terms_of) == []


def test_query_tokens_keep_case_and_order(spark):
    assert one(spark, "find the Parser of parser_x and Parser", T.query_tokens) == ["Parser", "parser_x"]


def test_test_paths(spark):
    yes = ["tests/test_foo.py", "pkg/foo_test.cpp", "src/CalculatorTests.cs", "a/foo.spec.ts", "test/x.cpp", "conftest.py"]
    no = ["src/contest.cpp", "game/latest.cpp", "util/fastest.h"]
    assert [one(spark, p, T.is_test_path) for p in yes + no] == [True] * 6 + [False] * 3


def test_lines_and_hashes(spark):
    assert one(spark, "a\r\nb\n", T.lines_of) == ["a", "b"]
    assert one(spark, "", T.lines_of) == []
    assert one(spark, "  a \n\n\tb\n", T.normalize_code) == "a\nb"
    assert one(spark, "def f():\n  x\n\n  y\n", T.fingerprint) == hashlib.sha256(b"x\ny").hexdigest()
    assert one(spark, "def f():\n", T.fingerprint) is None
    assert one(spark, " a   b ", T.signature_hash) == hashlib.sha256(b"a b").hexdigest()
    assert one(spark, None, T.signature_hash) is None


def test_refs(spark):
    assert one(spark, "a.py::C.m#block:x", T.ref_name) == "C.m"
    assert one(spark, "a.py::C.m", T.ref_path) == "a.py"
    assert one(spark, "a.py:10-20", lambda c: T.ref_lines(c)[1]) == 20
    assert one(spark, "a.py", T.ref_name) is None


def test_modules_and_languages(spark):
    assert [one(spark, p, T.module_key) for p in ("x.py", "a/x.py", "a/b/c/x.py")] == ["(root)", "a", "a/b"]
    assert one(spark, "a/b.PY", P.code_language) == "python"
    assert one(spark, "a/.py", P.code_language) is None
    assert one(spark, None, P.code_language) is None
    assert one(spark, "x.tsx", T.index_language) == "tsx"


def test_redaction(spark):
    key = "AKIA" + "A" * 16
    text = f'id = {key}\napi_key = "abcdefghijk"\n'
    df = spark.createDataFrame([(text,), ("x = 1",)], "x string")
    out, n = T.redact(F.col("x"))
    got = df.select(out.alias("o"), n.alias("n")).collect()
    assert got[0]["n"] == 2 and key not in got[0]["o"] and "***REDACTED***" in got[0]["o"]
    assert tuple(got[1]) == ("x = 1", 0)


def test_tokens_of_empty_text(spark):
    assert [one(spark, x, T.token_count) for x in ("", "a", "abcdefgh")] == [0, 1, 2]
