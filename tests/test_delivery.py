"""Refs against changed texts: the cases that a delivery has to get right."""

from corvane.operators import delivery as D

SYMBOL = "id string, repo_id string, path string, qualified_name string, start_line int, end_line int, signature_hash string, fingerprint string"
CARD = (
    "id string, repo_id string, path string, ref string, q string, is_file boolean, start_line int, end_line int, signature_hash string, content_hash string, "
    "fingerprint string, is_complete_unit int, unit_kind string, parent_ref string, expand string, view string"
)
TEXT = "\n".join(["import os", "", "class C:", "    def m(", "        self,", "    ):", "        return 1", "", "def f(a):", "    return a", "", "def f(a, b):", "    return b"])
SYMBOLS = [("C", "C", 3, 7, "sc", "bc"), ("m", "C.m", 4, 7, "sm", "bm"), ("f1", "f", 9, 10, "s1", "b1"), ("f2", "f", 12, 13, "s2", "b2")]


def deliver(spark, *cards, text=TEXT):
    """Cards as (id, q, start, end, signature, content hash, body, expand, view[, complete, parent])."""
    rows = []
    for id_, q, a, b, sh, ch, fp, expand, view, *rest in cards:
        whole, parent = rest or (1, None)
        rows.append((id_, "r", "a.py", f"a.py::{q}" if q else f"a.py:{a}-{b}" if a else "a.py", q, a is None and q is None, a, b, sh, ch, fp, whole, "ast_block", parent, expand, view))
    symbols = spark.createDataFrame([(i, "r", "a.py", q, a, b, s, f) for i, q, a, b, s, f in SYMBOLS] + [("m", "other", "a.py", "C.m", 1, 1, "sm", "bm")], SYMBOL)
    texts = spark.createDataFrame([("r", "a.py", text)], "repo_id string, path string, text string")
    return D.deliver(spark.createDataFrame(rows, CARD), texts, symbols, neighbors=2, max_lines=6)


def test_tiers(spark, rows):
    got = deliver(
        spark,
        ("by name", "C.m", 50, 60, None, "old hash", None, "exact", "full"),
        ("by signature", "f", 1, 2, "s2", None, None, "exact", "full"),
        ("by line", "f", 11, 12, "gone", None, None, "exact", "full"),
        ("by body", "old", 1, 2, None, None, "bm", "exact", "full"),
        ("lines left", "old", 2, 3, None, None, "nobody", "exact", "full"),
        ("nothing", "old", None, None, None, None, None, "exact", "full"),
        ("span", None, 9, 10, None, None, None, "exact", "full"),
        ("file", None, None, None, None, None, None, "exact", "head:1"),
    )
    assert rows(got, "asked_id", "how", "start_line", "end_line", "stale", "ambiguous") == sorted(
        [
            ("by name", "qname", 4, 7, True, False), ("by signature", "signature", 12, 13, False, False), ("by line", "qname", 12, 13, False, True),
            ("by body", "fingerprint", 4, 7, False, False), ("lines left", "line", 2, 3, True, False), ("nothing", None, None, None, None, False),
            ("span", "code", 9, 10, False, False), ("file", "file", 1, 1, False, False),
        ], key=str,
    )


def test_expand_view_and_clamp(spark, rows):
    ask = lambda name, expand, view: (name, "C.m", None, None, None, None, None, expand, view)
    got = deliver(
        spark, ask("parent", "parent", "full"), ask("near", "neighbors", "full"), ask("file", "file", "full"), ask("signature", "exact", "signature"), ask("head", "exact", "head:2"),
        ask("lines", "exact", "lines:6-5"), ask("odd", "sideways", "nonsense"), ("top", "f", 12, 13, "s2", None, None, "parent", "head:3"), ("past", None, 90, 99, None, None, None, "exact", "full"),
    )
    assert rows(got, "asked_id", "start_line", "end_line", "truncated") == sorted(
        [("parent", 3, 7, 0), ("near", 2, 7, 2), ("file", 1, 6, 7), ("signature", 4, 6, 0), ("head", 4, 5, 0), ("lines", 5, 6, 0), ("odd", 4, 7, 0), ("top", 1, 3, 0), ("past", 13, 13, 0)], key=str
    )
    assert rows(got.where("asked_id = 'lines'"), "code") == [("        self,\n    ):",)]


def test_partial_units_are_upgraded(spark, rows):
    part = ("part", None, 6, 7, None, None, None, "exact", "full", 0, "a.py::C.m")
    raw = ("raw", None, 6, 7, None, None, None, "block", "full", 0, "a.py::C.m")
    lone = ("lone", None, 6, 7, None, None, None, "exact", "full", 0, "a.py::nowhere")
    whole = ("m", "C.m", 4, 7, None, None, None, "exact", "full")
    got = deliver(spark, part, raw, lone, whole)
    assert rows(got, "asked_id", "ref", "start_line", "safe") == [("lone", "a.py:6-7", 6, False), ("m", "a.py::C.m", 4, True), ("part", "a.py::C.m", 4, True), ("raw", "a.py:6-7", 6, False)]
    assert got.where("asked_id = 'part'").first()["note"] == "auto-expanded from partial block a.py:6-7 to complete unit a.py::C.m"


def test_files_that_are_gone(spark, rows):
    card = ("x", "C.m", 4, 7, None, None, None, "exact", "full")
    assert rows(deliver(spark, card, text=None), "how", "start_line", "code") == [(None, None, None)]
