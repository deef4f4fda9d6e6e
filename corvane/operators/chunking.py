"""Cutting files into cards: windows, gaps between symbols, file cards; spans and refs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T


def window_chunks(files: DataFrame, size: int = 60, overlap: int = 10) -> DataFrame:
    """Windows of ``size`` lines that overlap: ``file_id, start_line, end_line, content``; blank ones are dropped."""
    step = size - overlap
    lines = files.select("file_id", T.lines_of(F.col("text")).alias("lines")).withColumn("n", F.greatest(F.size("lines"), F.lit(1)))
    last = F.greatest(F.lit(1), F.ceil((F.col("n") - overlap) / step) * step - step + 1)
    spans = lines.select("file_id", "lines", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))).alias("s"))
    ends = spans.select("file_id", F.col("s").cast("int").alias("start_line"), F.least(F.col("s") + size - 1, F.col("n")).cast("int").alias("end_line"), "lines")
    out = ends.select("file_id", "start_line", "end_line", T.line_slice(F.col("lines"), F.col("start_line"), F.col("end_line")).alias("content"))
    return out.where(F.col("content").rlike(r"\S"))


def merged_spans(spans: DataFrame, group: str = "file_id") -> DataFrame:
    """Overlapping spans joined: ``group, start_line, end_line``. Adjacent spans stay apart."""
    w = W.partitionBy(group).orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("start_line") > before), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def complement_gaps(files: DataFrame, spans: DataFrame, min_lines: int = 4) -> DataFrame:
    """What lies between the symbols of a file: ``file_id, start_line, end_line, n_filled`` of each gap
    with at least ``min_lines`` lines that are not blank."""
    lines = files.select("file_id", T.lines_of(F.col("text")).alias("lines"))
    covered = merged_spans(spans)
    w = W.partitionBy("file_id").orderBy("start_line")
    inner = covered.select("file_id", (F.coalesce(F.lag("end_line").over(w), F.lit(0)) + 1).alias("a"), (F.col("start_line") - 1).alias("b"))
    tail = covered.groupBy("file_id").agg((F.max("end_line") + 1).alias("a")).join(lines.select("file_id", F.size("lines").alias("b")), "file_id")
    gaps = inner.unionByName(tail).where("a <= b").join(lines, "file_id").where(F.col("a") <= F.size("lines"))
    filled = F.size(F.filter(F.slice("lines", F.col("a"), F.col("b") - F.col("a") + 1), lambda x: x.rlike(r"\S")))
    return gaps.select("file_id", F.col("a").alias("start_line"), F.col("b").alias("end_line"), filled.alias("n_filled")).where(F.col("n_filled") >= min_lines)


def file_cards(files: DataFrame, preview: int = 40) -> DataFrame:
    """One card for each file: its first lines and the hash of all of it."""
    lines = T.lines_of(F.col("text"))
    return files.where(F.col("text").rlike(r"\S")).select(
        "file_id", F.greatest(F.size(lines), F.lit(1)).alias("end_line"), T.line_slice(lines, F.lit(1), F.least(F.size(lines), F.lit(preview))).alias("content"), F.sha2(F.array_join(lines, "\n"), 256).alias("content_hash")
    )


def enclosing_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file_id, line, symbol_id``: the innermost symbol around each line of a file.

    The containment is joined within the file, which is the key of the join.
    """
    inside = points.join(symbols.select("file_id", F.col("id").alias("symbol_id"), "start_line", "end_line"), "file_id").where("line BETWEEN start_line AND end_line")
    return inside.groupBy("file_id", "line").agg(F.max_by("symbol_id", F.struct("start_line", -F.col("end_line"), "symbol_id")).alias("symbol_id"))


def resolve_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``ref, symbol_id, how`` of each symbol ref: unique, by signature, ambiguous or missing.

    ``refs`` has ``ref, path, qualified_name, signature_hash, fingerprint``. The name within the
    file decides; of several the one with the same signature, else the first; a name that is gone
    is followed to the only symbol of the file with the same body.
    """
    s = symbols.select("path", F.replace("qualified_name", F.lit("::"), F.lit(".")).alias("q"), F.col("id").alias("symbol_id"), F.col("signature_hash").alias("sh"), F.col("fingerprint").alias("fp"), "start_line")
    named = refs.withColumn("q", F.replace("qualified_name", F.lit("::"), F.lit("."))).join(s, ["path", "q"], "left")
    by = named.groupBy("ref", "path", "fingerprint").agg(
        F.count("symbol_id").alias("n"),
        F.count_if(F.col("sh") == F.col("signature_hash")).alias("same"),
        F.min_by("symbol_id", F.struct(F.coalesce((F.col("sh") != F.col("signature_hash")).cast("int"), F.lit(1)), "start_line", "symbol_id")).alias("symbol_id"),
    )
    bodies = s.where("fp IS NOT NULL").groupBy("path", F.col("fp").alias("fingerprint")).agg(F.count(F.lit(1)).alias("k"), F.min("symbol_id").alias("moved"))
    joined = by.join(bodies.where("k = 1"), ["path", "fingerprint"], "left")
    how = F.when(F.col("n") == 1, "unique").when((F.col("n") > 1) & (F.col("same") == 1), "signature").when(F.col("n") > 1, "ambiguous").when(F.col("moved").isNotNull(), "fingerprint").otherwise("missing")
    return joined.select("ref", F.coalesce("symbol_id", "moved").alias("symbol_id"), how.alias("how"))
