import datetime as dt

from corvane.operators.orphans import ForeignKey, orphan_report, orphans
from corvane.tables import SCHEMAS, empty

T = lambda d: dt.datetime(2025, 1, d)


def tables(spark, files, symbols, chunks, stones=()):
    f = spark.createDataFrame(files, "id string, last_indexed_at string")
    s = spark.createDataFrame(symbols, "id string, file_id string, indexed_at timestamp_ntz, extra int")
    c = spark.createDataFrame(chunks, "id string, symbol_id string, indexed_at timestamp_ntz, key string, at int")
    t = spark.createDataFrame(list(stones), SCHEMAS["tombstones"])
    return {"files": f, "symbols": s, "chunks": c}, t


def test_direct_cases(spark, rows):
    data, stones = tables(
        spark,
        [("F1", "2025-01-02T00:00:00Z"), ("F2", "2025-01-05T02:00:00+02:00"), ("F3", "2025-01-01T00:00:00+00:00"), ("F4", None)],
        [
            ("ok", " f1 ", T(2), 1),  # equal times are fine, keys are trimmed and folded
            ("late", "F2", T(4), 1),
            ("same", "F2", T(5), 1),
            ("gone", "F9", T(9), 1),
            ("dead", "f3", T(9), 1),
            ("none", None, T(9), 1),
            ("blank", "  ", T(9), 1),
            ("unknown", "F4", T(9), 1),
            (None, "F9", T(9), 1),
            ("gone", "F9", T(8), 1),
            ("null time", "F2", None, 1),
        ],
        [("c1", "GONE", T(9), "x", 1), ("c2", "ok", T(9), "x", 1), ("c3", "dead ", T(9), "x", 1), ("c4", "nowhere", T(9), "x", 1)],
        [("file", "F3", T(2)), ("file", " F3", T(1)), ("file", "F1", T(2)), ("symbol", "ok", T(1)), ("file", "never", T(1))],
    )
    found = orphans(data, tombstones=stones)
    assert rows(found, "ref_table", "row_id", "kind", "reason") == sorted(
        [
            ("symbols", "late", "direct", "late"),
            ("symbols", "gone", "direct", "missing"),
            ("symbols", "dead", "direct", "deleted"),
            ("chunks", "c4", "direct", "missing"),
            ("chunks", "c1", "inherited", "parent is an orphan"),
            ("chunks", "c3", "inherited", "parent is an orphan"),
        ],
        key=str,
    )
    report = {(r["ref_table"], r["kind"]): r["n_rows"] for r in orphan_report(found).groupBy("ref_table", "kind").sum("n_rows").withColumnRenamed("sum(n_rows)", "n_rows").collect()}
    assert report == {("symbols", "direct"): 3, ("chunks", "direct"): 1, ("chunks", "inherited"): 2}


def test_written_again_after_deletion_is_no_orphan(spark, rows):
    data, stones = tables(spark, [("F1", "2025-01-01T00:00:00Z"), ("F1", "2025-01-09T00:00:00Z")], [("s", "F1", T(5), 1)], [], [("file", "F1", T(9))])
    assert rows(orphans(data, tombstones=stones)) == []


def test_empty_tables(spark, rows):
    data = {n: empty(spark, n) for n in ("files", "symbols", "chunks")}
    assert rows(orphans(data, tombstones=empty(spark, "tombstones"))) == []
    assert rows(orphans(data)) == []


def test_cycle_reaches_fixpoint(spark, rows):
    node = spark.createDataFrame(
        [("a", "x", T(1)), ("b", "a", T(1)), ("c", "b", T(1)), ("d", "e", T(1)), ("e", "d", T(1))], "id string, up string, at timestamp_ntz"
    )
    found = orphans({"n": node}, [ForeignKey("n", "up", "n")], written_at={"n": "at"})
    assert rows(found, "row_id", "kind", "hops") == [("a", "direct", 0), ("b", "inherited", 1), ("c", "inherited", 2)]


def test_one_key_holds_most_rows(spark):
    chunks = spark.range(20_000).selectExpr("cast(id as string) id", "if(id % 3 = 0, 'S' || id, 'HOT') symbol_id", "timestamp_ntz'2025-01-01 00:00:00' indexed_at")
    data = {"files": empty(spark, "files"), "symbols": empty(spark, "symbols"), "chunks": chunks}
    assert orphans(data).count() == 20_000
