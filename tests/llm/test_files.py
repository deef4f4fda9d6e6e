import ast
import json
import random
import re
import signal
from xml.parsers import expat

import pytest

from corvane.llm.docpairs import describe, documented_symbols, functions_of
from corvane.llm.provenance import classify_files, machine_made
from corvane.llm.syntax import check_syntax, invalid_rates, syntax_error

RAW = "file_id string, repo_id string, path string, text string"
CODE = "import os\n\n\ndef f(x):\n    return os.path.join(x, 'a')\n" * 8


def files(spark, *rows):
    return spark.createDataFrame([(str(k), "r", p, t) for k, (p, t) in enumerate(rows)], RAW)


CASES = [
    ("a/x_pb2.py", CODE, "generated"),
    ("a/x.go", "// Copyright the team\n// Code generated by tool v1. DO NOT EDIT.\npackage a\n", "generated"),
    ("a/x.py", "# source: a/b.proto\n# checksum: 12ab\nclass A: pass\n", "generated"),
    ("a/y.py", "# Was generated by tool once; maintained by hand since the split.\n" + CODE, "hand_written"),
    ("a/z.py", 'BANNER = "Code generated by {tool}. DO NOT EDIT."\n' + CODE, "hand_written"),
    ("third_party/lib/x.py", CODE, "vendored"),
    ("core/vendor/x.py", CODE, "hand_written"),
    ("vendor_portal/a/x.py", CODE, "hand_written"),
    ("src/q.py", "# lib - upstream copy, rev 12\n" + CODE, "vendored"),
    ("src/long.py", "# a line of the licence\n" * 45 + "# Code generated by a tool. DO NOT EDIT.\n" + CODE, "generated"),
    ("src/block.cpp", "#ifndef A_H\n#define A_H\n/*\n   Written by a tool.\n" + "   More words.\n" * 60 + "   Do not edit.\n*/\nint f();\n", "generated"),
    ("src/after.cpp", "int f();\n// Do not edit this list without the tests.\n", "hand_written"),
    ("src/open.js", "/* do not edit", "generated"),
    ("src/many.ts", "// Copyright (c) the Quill authors\n" + "let a = 1;\n", "vendored"),
    ("src/team.ts", "// Copyright the Quill team. All rights reserved.\n// Ask the maintainers before a release.\nlet a = 1;\n", "hand_written"),
    ("src/d.py", "D = [\n" + "    1, 2, -3, 0x1f,\n" * 60 + "]\n", "data"),
    ("src/t.py", CODE + "T = [1, 2, 3]\n", "hand_written"),
    ("src/m.js", "!function(a){a.b=a.c||{}}(window);var e={f:1};" * 30, "minified"),
    ("src/l.js", "const a = 1;\n" * 30 + "const s = '" + "word and more " * 40 + "';\n", "hand_written"),
    ("package-lock.json", "{}", "lockfile"),
    ("a/e.py", "", "hand_written"),
    ("a/n.py", None, "hand_written"),
    (None, CODE, "hand_written"),
]


def test_origins(spark):
    df = files(spark, *[c[:2] for c in CASES]).selectExpr("*", "'x' as language", "1 as origin")
    got = {r["file_id"]: r["origin"] for r in classify_files(df).collect()}
    assert got == {str(k): c[2] for k, c in enumerate(CASES)}
    found = {r["file_id"] for r in machine_made(df.union(df)).collect()}
    assert found == {str(k) for k, c in enumerate(CASES) if c[2] not in ("hand_written", "lockfile")}
    assert classify_files(df.limit(0)).count() == 0


VALID = {
    "python": ["match x:\n    case {'a': [1, *_], **rest} if (y := f(x)) else_:\n        pass\n".replace(" else_", ""), 'f"{x!r :>{w}} {d["k"]} {{}} {y=}"\n', "type X[T: int] = list[T]\n@a.b(c)\nasync def f[T](a, /, b=1, *c, d: int = 2, **e) -> T:\n    return await x if y else lambda z=1, *w: (yield)\n", "x = 1\n", "", "\ufeffx = 'a'\r\n", 's = """\n<<<<<<< HEAD\n"""\n', "# {{ x }} “a”\n", 'f"{x[\'a\']}"\n'],
    "javascript": ["const a = `x ${b ? `y` : '}'} z`;\n", "// don't {\nfoo(/[)\"]+/g);\n", "export const x = [1, 2];\n", "\n"],
    "typescript": ["export function f(a: string[]): number {\n  return a.length as any;\n}\n", "interface A {\n  b?: number;\n}\n", "const s = `${f({b: {c: `${d ? `}` : e}`}})}`;\nconst a = [1, , 0x1F, 1e5, 10n];\n"],
    "go": ["package a\n\nfunc F(x string, y int) ([]int, error) {\n\ts := `{`\n\treturn nil, nil // (\n}\n", "// only a comment\npackage a\n"],
    "cpp": ['#include <string>\nstatic const int k = 1;\nclass A {\npublic:\n    int f() const { return \'{\'; }\n};\n', 'auto s = R"(()")";\n'.replace('()")', "x)"),
        "#define BEGIN namespace a {\n#define END }\nBEGIN\nint f(int* p) { return -*p + operator=(1) + 0x1F + 10_km; }\nEND\n",
        "void f() {\n#ifdef A\n  if (a) {\n#else\n  if (b) {\n#endif\n  }\n}\n#if 0\n}}}\n#endif\n"],
    "c_sharp": ['using System;\nnamespace A\n{\n    class B { string s = $"{x}: {"}"}"; string p = @"c:\\"; }\n}\n'],
    "json": ['{"a": [1, null]}', '{"a": 1, "b": {"c": [1, 2.5, "x"], "d": {}}, "e": []}'],
    "xml": ['<?xml version="1.0" encoding="utf-16"?><a><b/></a>'],
}
INVALID = {
    "python": ["def f(:\n", "x = (1\n", "print 'a'\n", "s = 'a\n", "<<<<<<< HEAD\nx = 1\n", "   1 | x = 1\n   2 | y = 2\n", "x = “a”\n", "x = 1\0\n"],
    "javascript": ["function f( {\n", "const a = 'x;\n", "let x: string = 'a';\n", "We moved the cache today.\n", "package a\n", "=======\n", "foo(); ]\n", "const x =\n", '{"a": 1}', "let 1a = 2;\n", "var = 3;\n", "let x = ;\n", "f(1,,2);\n", "let y = 1 +* 2;\n", "if () {\n}\n"],
    "typescript": ["export class {{ name }} {\n}\n", "using System;\nclass A {}\n", "def f():\n    pass\n"],
    "go": ["func F() {}\n", "package a\nfunc F() {\n", "package a\nx := “a”\n", "package a\nfunc F() { )\n}\n", "package a\nfunc F( {\n}\n)\n", "package a\nvar x = 1 + ;\n"],
    "cpp": ["int f() {\n", "using System;\n", "package a\n", "int x = 1\n", "import logging\n", "int x = ;\n", "int y = f(1,,2);\n", "#define BEGIN namespace a {\nBEGIN\nint x;\n"],
    "c_sharp": ["class A {\n", "#include <string>\nint x;\n", "class A { string s = \"a; }\n"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "// x\n{}", "NaN"],
    "xml": ["", "<a><b></a>", "text"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    assert [(t, syntax_error(t, language)) for t in VALID[language] if syntax_error(t, language)] == []


@pytest.mark.parametrize("language", INVALID)
def test_invalid(language):
    assert [t for t in INVALID[language] if not syntax_error(t, language)] == []


TOKENS = re.compile(r"\w+|\s+|.", re.S)


def mangled(texts, rng, n):
    """Texts with a token left out, repeated or moved, or without an end."""
    for text in texts:
        parts = TOKENS.findall(text)
        for _ in range(n if len(parts) > 3 else 0):
            new, k, j = list(parts), rng.randrange(len(parts)), rng.randrange(len(parts))
            how = rng.randrange(4)
            if how == 0:
                del new[k]
            elif how == 1:
                new.insert(k, new[j])
            elif how == 2:
                new[k], new[j] = new[j], new[k]
            else:
                del new[k:]
            yield "".join(new)


def parses(text, language):
    try:
        if language == "python":
            ast.parse(text)
        elif language == "json":
            json.loads(text, parse_constant=lambda name: int("x"))
        else:
            expat.ParserCreate().Parse(text.encode(), True)
    except (SyntaxError, ValueError, expat.ExpatError):
        return False
    return True


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize(("language", "endings"), [("python", (".py",)), ("json", (".json",)), ("xml", (".xml", ".csproj", ".props"))])
def test_automata_agree_with_whole_parsers(folder, language, endings):
    import pandas as pd

    raw = pd.read_parquet(f"{folder}/raw_files.parquet")
    texts = [t.removeprefix("\ufeff") for p, t in zip(raw["path"], raw["text"]) if t and p.lower().endswith(endings) and "encoding" not in t[:60]]
    cases = texts + list(mangled(texts, random.Random(5), 20))
    assert len(cases) > 40
    assert [t for t in cases if bool(syntax_error(t, language)) == parses(t, language)] == []


def test_check_syntax(spark, rows):
    df = files(spark, ("a.py", "x = (\n"), ("a.py", None), ("a.md", "x = ("), (None, "x"), ("b.json", ""), ("c.PY", "x = 1\n"))
    checked = check_syntax(df)
    assert rows(checked.where("error IS NOT NULL"), "file_id", "line") == [("0", 1), ("4", 1)]
    assert rows(invalid_rates(checked), "language", "n_files", "n_invalid", "rate") == [("json", 1, 1, 1.0), ("python", 3, 1, 1 / 3)]
    assert check_syntax(df.limit(0)).count() == 0


SAYS = ["Never returns null.", "// Linear in size.", "/**\n * Counts bytes, not characters.\n * @param x\n */", "/// <summary>\n/// Blocks for 9 ms.\n/// </summary>",
        "@param limit how many rows to keep at most", "Refreshes the other cache.", "Liefert nur neue Zeilen."]
NOTHING = ["", "// ", "TODO: write proper docs\nwhen there is time", "function", "n/a", "See base class.", "{@inheritDoc}", "/// <inheritdoc/>", "// eslint-disable-next-line x", "noqa: E501",
           "@param x\n@returns", ":param x:\n:return:", "----------", "// if (a == null) {;", "state.x = foo(a);", "Load cache.", "Loads the cache.", "load_cache()", "The load cache function.",
           "Licensed under the Public Terms, version 2. You may not use this file", "/// <summary>\n/// \n/// </summary>\n/// <param name=\"x\"></param>", "Documentation goes here, please fill in"]


def test_what_comments_say():
    assert [c for c in SAYS if not describe(c, "loadCache")] == []
    assert [c for c in NOTHING if describe(c, "loadCache")] == []


def test_functions():
    py = 'class A:\n    @x\n    def f(\n        self,\n    ) -> int:\n        # note\n        r"""Sums up, slowly."""\n        return 1\n\n    def g(self): pass\n'
    got = functions_of(py, "python")
    assert [(f["name"], f["line"], f["end_line"], f["description"]) for f in got] == [("f", 3, 8, "Sums up, slowly."), ("g", 10, 10, "")]
    js = "/** Keeps order. */\n\nexport function a(x) {\n  return x;\n}\n\nclass B {\n  // Frees memory.\n  c(\n    d\n  ) {\n    if (d) {\n    }\n  }\n}\n"
    assert [(f["name"], f["line"], f["end_line"], f["description"]) for f in functions_of(js, "javascript")] == [("a", 3, 5, "Keeps order."), ("c", 9, 14, "Frees memory.")]


def test_bodies():
    def code(text, language):
        return {f["name"]: f["code"] for f in functions_of(text, language)}

    text = "function b() {\nreturn 2;\n}\nfunction c() {\n  const s = `\n}\n${d ? `{` : 1}`;\n  return s; // }\n}\nconst e = (x) => x + 1;\nconst g = (x) =>\n  x + 2\nfoo();\n"
    assert code(text, "javascript") == {
        "b": "function b() {\nreturn 2;\n}",
        "c": "function c() {\n  const s = `\n}\n${d ? `{` : 1}`;\n  return s; // }\n}",
        "e": "const e = (x) => x + 1;",
        "g": "const g = (x) =>\n  x + 2",
    }
    text = "func F(a map[string]struct{}) (map[string]interface{}, error) {\nx := '{'\nreturn nil, nil\n}\nfunc G() interface{} { return 1 }\n"
    assert code(text, "go") == {"F": text[: text.index("\nfunc G")], "G": "func G() interface{} { return 1 }"}
    text = "A::A(int x) : a{x}, b{2} {\nrun();\n}\nint f()\n{\n  return 1;\n}\n"
    assert code(text, "cpp") == {"A": "A::A(int x) : a{x}, b{2} {\nrun();\n}", "f": "int f()\n{\n  return 1;\n}"}
    text = 'class A {\n  public int F(int x) => x\n    + 1;\n  public abstract void G();\n  public void H()\n  {\n    var s = @"}";\n  }\n}\n'
    assert code(text, "c_sharp") == {"F": "  public int F(int x) => x\n    + 1;", "G": "  public abstract void G();", "H": '  public void H()\n  {\n    var s = @"}";\n  }'}
    text = 'def f():\n    s = """\nnot the end\n"""\n    x = (\n1)\n    def g():\n        return 2\n    # inside\n\n# outside\ny = 1\n'
    assert code(text, "python") == {"f": text[: text.index("\n\n# outside")], "g": "    def g():\n        return 2"}
    assert code('def f(:\n  x = """\n\ndef g():\n  pass\n', "python").keys() == {"f", "g"}
    assert code("function f() {\n  if (x) {\n}\n\nfunction g() {\n}\n", "javascript") == {"f": "function f() {\n  if (x) {\n}", "g": "function g() {\n}"}


def test_documented_symbols(spark, rows):
    text = "// Keeps the order of rows.\nfunc F() {\n\treturn\n}\n\n// F\nfunc G() {}\n"
    raw = spark.createDataFrame([(" F1", "r", "a.go", text), (" F1", "r", "a.go", text), ("f2", "r", "b.go", None)], RAW)
    symbols = spark.createDataFrame(
        [("s1", "f1 ", " Function", 2, "wrong", "x"), ("s1", "f1", "function", 2, "wrong", "x"), ("s2", "f1", "method", 7, None, "x"), ("s3", "f9", "function", 2, None, "x"), ("s4", "f1", "class", 2, None, "x"), (None, "f1", "function", 2, None, "x"), ("s5", None, None, None, None, "x")],
        "id string, file_id string, symbol_type string, start_line int, summary string, description string",
    )
    got = documented_symbols(symbols, raw)
    assert rows(got, "symbol_id", "name", "description", "code") == [("s1", "F", "Keeps the order of rows.", "func F() {\n\treturn\n}")]
    assert documented_symbols(symbols.limit(0), raw).count() == 0


def test_json_of_any_depth():
    from corvane.llm.syntax_data import json_error

    deep = "[" * 200_000 + '{"a": [1, -2.5e3, "\\u00e9", {}, [], null]}' + "]" * 200_000
    assert syntax_error(deep, "json") is None
    assert syntax_error(deep[:-1], "json") and syntax_error(deep + "]", "json") and syntax_error(deep.replace("{}", "{,}"), "json")
    for text in ('', '[1,]', '{"a":}', '{"a" 1}', '{1: 2}', '[1 2]', '[}', '01', '["\t"]', '1 2', 'nul', '{"a": 1,}', '[,1]'):
        assert json_error(text) and syntax_error(text, "json"), text
    for text in ('1', ' [ ] ', '{ }', '{"a": [true, {"b": "x"}]}', '"s"'):
        assert json_error(text) is None and syntax_error(text, "json") is None, text


@pytest.mark.parametrize(
    "text, language, names",
    [
        ("Foo::Foo(int n)\n    : " + "a::b " * 200 + ";\nint g(int x) { return x; }\n", "cpp", ["g"]),
        ("auto f(int n) " + "-> a :b" * 200 + ";\nint g() const -> std::vector<int>\n{\n}\n", "cpp", ["g"]),
        ("def f():\n    '" + "\\a" * 200 + "\n\n\ndef g():\n    pass\n", "python", ["f", "g"]),
    ],
)
def test_what_ends_nowhere_is_refused_in_one_pass(text, language, names):
    def late(*_):
        raise TimeoutError

    signal.signal(signal.SIGALRM, late)
    signal.alarm(10)  # tried in all ways, it does not end
    try:
        assert [f["name"] for f in functions_of(text, language)] == names
    finally:
        signal.alarm(0)
