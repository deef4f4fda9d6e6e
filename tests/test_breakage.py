"""Fates of symbols and what they break."""

from corvane.operators import changes as C

SYMBOL = "id string, repo_id string, path string, qualified_name string, name string, signature_hash string, fingerprint string"
PLACE = "repo_id string, path string"


def symbols(spark, *rows):
    return spark.createDataFrame([(i, "r", p, q, q.split(".")[-1], s, f) for i, p, q, s, f in rows], SYMBOL)


def test_fates_and_broken_calls(spark, rows):
    before = symbols(
        spark, ("gone", "a.py", "gone", "s", "b1"), ("old", "a.py", "C.old", "s", "b2"), ("sig", "a.py", "sig", "s1", "b3"), ("same", "a.py", "same", "s", "b4"), ("twin", "a.py", "twin", "s", "b5"),
        ("away", "b.py", "away", "s", "b6"), ("quiet", "c.py", "quiet", "s", "b7"),
    )
    live = symbols(spark, ("x", "a.py", "C.new", "s", "b2"), ("y", "a.py", "sig", "s2", "b9"), ("z", "a.py", "same", "s", "b0"), ("t", "a.py", "t1", "s", "b5"), ("u", "a.py", "t2", "s", "b5"))
    changed = spark.createDataFrame([("r", "a.py"), ("r", "b.py")], PLACE)
    deleted = spark.createDataFrame([("r", "b.py")], PLACE)
    found = C.fates(before, live, changed, deleted)
    assert rows(found, "symbol_id", "fate", "now") == [
        ("away", "file_deleted", None), ("gone", "removed", None), ("old", "renamed", "C.new"), ("sig", "signature_changed", None), ("twin", "removed", None),
    ]
    callers = spark.createDataFrame([("old", "k1", "confident"), ("old", "k2", "possible"), ("same", "k1", "confident")], "target_id string, source_id string, tier string")
    assert rows(C.broken_calls(found, callers), "symbol_id", "n_confident", "n_possible") == [("old", 1, 1)]
    imports = spark.createDataFrame([("r", "u.py", "b"), ("r", "u.py", "gone"), ("r", "v.py", "away"), ("r", "v.py", "sig"), ("q", "w.py", "b"), ("r", "u.py", None)], "repo_id string, path string, name string")
    assert rows(C.dangling_imports(found, deleted, imports), "importer_path", "name", "why") == [
        ("u.py", "b", "module or file deleted"), ("u.py", "gone", "symbol removed or renamed"), ("v.py", "away", "file of the symbol deleted"),
    ]
    assert C.fates(before.limit(0), live, changed, deleted).count() == 0
