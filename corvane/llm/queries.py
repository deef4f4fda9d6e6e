"""The queries of problems 1 to 3 and 5 to 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm.abuse import abuse_rates, score_documents, train
from corvane.llm.docpairs import documented_symbols
from corvane.llm.leakage import find_leaks
from corvane.llm.packing import fill_report, pack, token_counts
from corvane.llm.provenance import CODE, classify_files, machine_made
from corvane.llm.registry import ORACLES, QUERIES, query
from corvane.llm.splitting import split_oversized, with_limits
from corvane.llm.syntax import check_syntax, invalid_rates
from corvane.tables import load

__all__ = ["ORACLES", "QUERIES"]


@query(
    "p1_found",
    """
    SELECT DISTINCT c.id AS chunk_id
    FROM chunks c LEFT JOIN chunk_limits l ON l.chunk_type = lower(trim(c.chunk_type))
    WHERE length(c.content) > coalesce(l.max_chars, (SELECT max_chars FROM chunk_limits WHERE chunk_type = 'default'))
    """,
)
def p1_found(spark, folder):
    """Chunks longer than their type allows."""
    return split_oversized(load(spark, folder, "chunks"), load(spark, folder, "chunk_limits")).select("chunk_id").distinct()


@query("p1_pieces")
def p1_pieces(spark, folder):
    """The pieces of all oversized chunks."""
    return split_oversized(load(spark, folder, "chunks"), load(spark, folder, "chunk_limits"))


@query(
    "p1_rebuilt",
    """
    SELECT DISTINCT c.id AS chunk_id, sha256(content) AS content_hash, sha256(content) AS rebuilt_hash, CAST(length(content) AS BIGINT) AS n_chars, true AS within_limit
    FROM chunks c LEFT JOIN chunk_limits l ON l.chunk_type = lower(trim(c.chunk_type))
    WHERE length(c.content) > coalesce(l.max_chars, (SELECT max_chars FROM chunk_limits WHERE chunk_type = 'default'))
    """,
)
def p1_rebuilt(spark, folder):
    """The pieces of each oversized chunk put together again: they give its content, each within the limit."""
    chunks, limits = load(spark, folder, "chunks"), load(spark, folder, "chunk_limits")
    pieces = split_oversized(chunks, limits).withColumn("own", F.expr("substring(content, overlap_chars + 1)")).withColumn("size", F.char_length("content"))
    pieces = pieces.groupBy("chunk_id", "content_hash", "piece_no").agg(F.max("own").alias("own"), F.max("size").alias("size"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")
    built = pieces.groupBy("chunk_id", "content_hash").agg(whole.alias("whole"), F.max("size").alias("size"))
    limit = with_limits(chunks.select("id", "content", "chunk_type"), limits).groupBy(F.col("id").alias("chunk_id"), F.sha2("content", 256).alias("content_hash")).agg(F.max("max_chars").alias("most"))
    joined = built.join(limit, ["chunk_id", "content_hash"])
    return joined.select("chunk_id", "content_hash", F.sha2("whole", 256).alias("rebuilt_hash"), F.char_length("whole").cast("bigint").alias("n_chars"), (F.col("size") <= F.col("most")).alias("within_limit"))


@query("p2_found")
def p2_found(spark, folder):
    """Code files that were generated, minified, copied in or hold nothing but data."""
    return machine_made(load(spark, folder, "raw_files"))


@query("p2_rates")
def p2_rates(spark, folder):
    """Code files by repository, language and origin."""
    kinds = classify_files(load(spark, folder, "raw_files")).where(F.col("language").isin(*CODE))
    return kinds.groupBy("repo_id", "language", "origin").agg(F.countDistinct("file_id").alias("n_files"))


@query("p3_found")
def p3_found(spark, folder):
    """Files whose text does not obey the grammar of their language."""
    checked = check_syntax(load(spark, folder, "raw_files"))
    return checked.where(F.col("error").isNotNull()).select("file_id").distinct()


@query("p3_rates")
def p3_rates(spark, folder):
    """Invalid files by repository and language."""
    return invalid_rates(check_syntax(load(spark, folder, "raw_files")))


@query("p5_found")
def p5_found(spark, folder):
    """Functions and methods whose documentation says something."""
    return documented_symbols(load(spark, folder, "symbols"), load(spark, folder, "raw_files")).select("symbol_id")


@query("p5_pairs")
def p5_pairs(spark, folder):
    """Code and description of all documented functions."""
    return documented_symbols(load(spark, folder, "symbols"), load(spark, folder, "raw_files"))


@query("p7_found")
def p7_found(spark, folder):
    """Documents with the benchmark items that leaked into them."""
    return find_leaks(load(spark, folder, "documents"), load(spark, folder, "benchmark")).select("doc_id", "item_id").distinct()


@query("p7_items")
def p7_items(spark, folder):
    """For each benchmark item, in how many documents it leaked and how much of it at most."""
    leaks = find_leaks(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
    return leaks.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_documents"), F.max("matched_words").alias("most_words"), F.max("own_words").alias("own_words")
    )


def _scored(spark, folder):
    documents = load(spark, folder, "documents")
    return score_documents(documents, train(documents, load(spark, folder, "labels")))


@query("p8_found")
def p8_found(spark, folder):
    """Documents with a passage that insults, threatens, demeans a group or is sexually explicit."""
    return _scored(spark, folder).where(F.col("abusive") & F.col("doc_id").isNotNull()).select("doc_id").distinct()


@query("p8_scores")
def p8_scores(spark, folder):
    """The score of every document."""
    return _scored(spark, folder)


@query("p8_rates")
def p8_rates(spark, folder):
    """Abusive documents by source."""
    return abuse_rates(_scored(spark, folder))


@query("p6_containers")
def p6_containers(spark, folder):
    """Documents in containers of each budget, none split unless it alone exceeds the capacity."""
    return pack(token_counts(load(spark, folder, "documents")), load(spark, folder, "context_budgets"))


@query("p6_fill")
def p6_fill(spark, folder):
    """How full the containers of each budget are."""
    return fill_report(p6_containers(spark, folder))
