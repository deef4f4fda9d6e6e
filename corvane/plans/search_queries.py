"""Searches. The queries are the documents (or vectors) whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import retrieval as R
from corvane.plans import base
from corvane.plans.registry import query
from corvane.plans.text_queries import _STOP, _W, _terms
from corvane.tables import load


def _documents(spark, folder):
    d = load(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", "title", "source")


def _queries(spark, folder):
    d = load(spark, folder, "documents").where(F.col("doc_id") % 100 == 0)
    return d.select(F.col("doc_id").alias("query_id"), F.coalesce("title", "text").alias("query"))


_ASKED = "q AS (SELECT doc_id AS query_id, coalesce(title, text) AS query FROM documents WHERE doc_id % 100 = 0)"
_TOKENS = (
    f"qt AS (SELECT DISTINCT query_id, lower(token) AS token FROM (SELECT query_id, unnest(regexp_extract_all(coalesce(query, ''), '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM q) "
    f"WHERE length(token) >= 3 AND lower(token) NOT IN ({_STOP}))"
)
_SYMBOL = """sy AS (SELECT query_id, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
  SELECT query_id, id, max(CASE WHEN lower(name) = token THEN 1.0 WHEN starts_with(lower(name), token) THEN 0.7 ELSE 0.4 END)::DOUBLE AS score
  FROM s JOIN qt ON contains(lower(name), token) GROUP BY 1, 2)) WHERE rn <= 10)"""
_BM25 = """dt AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents),
ds AS (SELECT doc_id AS id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS n_terms FROM documents),
po AS (SELECT term, id, count(*) AS tf FROM dt GROUP BY 1, 2),
qp AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(coalesce(query, '')), '[\\p{L}\\p{N}]+')) AS prefix FROM q),
vp AS (SELECT v.term, p.prefix FROM (SELECT DISTINCT term FROM po) v JOIN (SELECT DISTINCT prefix FROM qp) p ON starts_with(v.term, p.prefix)),
pf AS (SELECT prefix, id, CAST(sum(tf) AS BIGINT) AS tf FROM po JOIN vp USING (term) GROUP BY 1, 2),
st AS (SELECT count(*) AS n_docs, avg(n_terms) AS avg_terms FROM ds),
idf AS (SELECT prefix, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) AS idf, avg_terms FROM (SELECT prefix, count(*) AS df FROM pf GROUP BY 1), st),
bm AS (SELECT query_id, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
  SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n_terms / avg_terms))) AS score FROM qp JOIN pf USING (prefix) JOIN idf USING (prefix) JOIN ds USING (id) GROUP BY 1, 2)) WHERE rn <= 20)"""


def _round(x: str, n: int) -> str:
    return f"floor({x} * 1e{n} + 0.5) / 1e{n}"


@query("symbol_lookup", _W + f", {_ASKED}, {_TOKENS}, {_SYMBOL} SELECT sy.query_id, sy.id, sy.score, s.name FROM sy JOIN s USING (id)")
def symbol_lookup(spark, folder):
    s = base.symbols(spark, folder)
    hits = R.symbol_channel(s, _queries(spark, folder))
    return hits.join(s.select("id", "name"), "id").select("query_id", "id", "score", "name")


@query("bm25_topk", f"WITH {_ASKED}, {_BM25} SELECT query_id, id, round(score, 6) AS score FROM bm")
def bm25_topk(spark, folder):
    return R.bm25(_documents(spark, folder), _queries(spark, folder)).withColumn("score", F.round("score", 6))


@query(
    "postings",
    f"WITH {_BM25.split('qp AS')[0].rstrip().rstrip(',')} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS most FROM po GROUP BY 1",
)
def postings(spark, folder):
    """The vocabulary of the inverted index, with document and collection frequencies."""
    index, _ = R.postings(_documents(spark, folder))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most"))


_DIST = "list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"


def _nearest(k: int, own: bool) -> str:
    return f"""SELECT query_id, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
      SELECT q.vec_id AS query_id, v.vec_id AS id, -round({_DIST}, 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 {'' if own else 'AND v.vec_id <> q.vec_id'})) WHERE rn <= {k}"""


@query("vector_topk", _nearest(20, True))
def vector_topk(spark, folder):
    v = load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.vector_channel(v, v.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id"))


@query("similar_items", _nearest(5, False))
def similar_items(spark, folder):
    v = load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.vector_channel(v, v.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id"), k=5, exclude_self=True)


@query(
    "hash_embedding",
    """SELECT id, floor(sqrt(sum(n * n)) * 1e6 + 0.5) / 1e6 AS norm, CAST(max(n) AS BIGINT) AS most, count(*) AS n_buckets FROM (
       SELECT id, b, count(*) AS n FROM (SELECT doc_id AS id, CAST('0x' || right(md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))), 8) AS BIGINT) % 64 AS b FROM documents) GROUP BY 1, 2) GROUP BY 1""",
)
def hash_embedding(spark, folder):
    """Facts of the hashed bag-of-words vector of each document; its length before scaling among them."""
    return _embedding_facts(spark, folder)


def _embedding_facts(spark, folder):
    d = _documents(spark, folder)
    e = R.hash_embedding(d)
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    n = d.select("id", F.size(words).alias("n_words"))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    norm = F.col("n_words") / total
    return e.join(n, "id").select(
        "id",
        (F.floor(norm * 1e6 + 0.5) / 1e6).alias("norm"),
        F.round(F.array_max("vector") * norm).cast("bigint").alias("most"),
        F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("n_buckets"),
    )


def _channels(spark, folder):
    d = _documents(spark, folder)
    asked = _queries(spark, folder)
    titled = d.select("id", F.col("title").alias("name"))
    return {
        "symbol": R.title_channel(titled, asked),
        "keyword": R.bm25(d, asked),
        "vector": R.hashed_channel(d, asked),
    }


#: The vector channel over hashed words: documents and queries as counts by bucket, of unit length.
_HASHED = """hw AS (SELECT id, b, count(*)::DOUBLE AS n FROM (SELECT doc_id AS id, CAST('0x' || right(md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))), 8) AS BIGINT) % 64 AS b FROM documents) GROUP BY 1, 2),
hq AS (SELECT id, b, count(*)::DOUBLE AS n FROM (SELECT query_id AS id, CAST('0x' || right(md5(unnest(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9_]+'))), 8) AS BIGINT) % 64 AS b FROM q) GROUP BY 1, 2),
wn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM hw GROUP BY 1), qn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM hq GROUP BY 1),
dp AS (SELECT hq.id AS query_id, hw.id, sum(hq.n * hw.n) AS dot FROM hq JOIN hw USING (b) GROUP BY 1, 2),
ve AS (SELECT query_id, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
  SELECT qn.id AS query_id, wn.id, -round(2 - 2 * coalesce(dot, 0) / (qn.norm * wn.norm), 6) AS score FROM qn CROSS JOIN wn LEFT JOIN dp ON dp.query_id = qn.id AND dp.id = wn.id)) WHERE rn <= 20)"""
_DOCSYM = """ds1 AS (SELECT query_id, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
  SELECT query_id, doc_id AS id, max(CASE WHEN lower(title) = token THEN 1.0 WHEN starts_with(lower(title), token) THEN 0.7 ELSE 0.4 END)::DOUBLE AS score
  FROM documents JOIN qt ON contains(lower(title), token) WHERE title IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 10)"""


def _scaled(channel: str, table: str) -> str:
    return f"""SELECT query_id, id, '{channel}' AS channel, CASE WHEN hi - lo < 1e-9 THEN 0.7 ELSE (score - lo) / (hi - lo) END AS value
      FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {table})"""


_VALUES = f"vl AS (SELECT query_id, id, 'symbol' AS channel, score AS value FROM ds1 UNION ALL {_scaled('keyword', 'bm')} UNION ALL {_scaled('vector', 've')})"
_HYBRID = f"WITH {_ASKED}, {_TOKENS}, {_BM25}, {_DOCSYM}, {_HASHED}, {_VALUES} "


def _merged(symbol: float, keyword: float, vector: float) -> str:
    each = ", ".join(f"coalesce(max(value) FILTER (channel = '{c}'), 0)::DOUBLE AS {c}" for c in ("symbol", "keyword", "vector"))
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
      SELECT *, round({symbol}::DOUBLE * symbol + {keyword}::DOUBLE * keyword + {vector}::DOUBLE * vector, 6) AS score FROM (SELECT query_id, id, {each} FROM vl GROUP BY 1, 2))"""


@query(
    "hybrid_topk",
    _HYBRID
    + f"""SELECT query_id, id, score, round(symbol, 4) AS symbol, round(keyword, 4) AS keyword, round(vector, 4) AS vector, CAST(rn AS INT) AS rank, title, source
      FROM ({_merged(0.40, 0.30, 0.30)}) m JOIN documents d ON d.doc_id = m.id WHERE rn <= 10""",
)
def hybrid_topk(spark, folder):
    """Title, keyword and vector channels merged with the default weights: the flagship search."""
    return R.merge_channels(_channels(spark, folder), R.MODES["default"]).join(_documents(spark, folder).select("id", "title", "source"), "id", "left")


#: Symbol, keyword and vector weights by mode, as the index states them.
_WEIGHTS = {"default": (0.40, 0.30, 0.30), "impact": (0.55, 0.25, 0.20), "discovery": (0.25, 0.25, 0.50), "bugfix": (0.25, 0.55, 0.20)}


@query("hybrid_modes", _HYBRID + " UNION ALL ".join(f"SELECT '{m}' AS mode, query_id, id, score FROM ({_merged(*w)}) WHERE rn <= 10" for m, w in _WEIGHTS.items()))
def hybrid_modes(spark, folder):
    """All three channels merged under each mode."""
    return R.merge_modes(_channels(spark, folder), R.MODES).select("mode", "query_id", "id", "score")


def _cards(spark, folder):
    """Chunks found by name for each query, as cards with ranks."""
    c = base.chunks(spark, folder)
    s = base.symbols(spark, folder)
    hits = R.symbol_channel(s, _queries(spark, folder), k=40).withColumnRenamed("id", "symbol_id")
    cards = hits.join(c.select("id", "symbol_id", "ref", "path", "start_line", "content", "summary", "chunk_type", "qualified_name"), "symbol_id").join(
        s.select(F.col("id").alias("symbol_id"), "name"), "symbol_id"
    )
    return cards.withColumn("is_complete", F.col("chunk_type").isin("function", "method")).withColumn("is_symbol", F.col("chunk_type").isin("function", "method", "class"))


_CARDS = f"""{_ASKED}, {_TOKENS}, {_SYMBOL.replace('rn <= 10', 'rn <= 40')},
ca AS (SELECT sy.query_id, sy.score, c.id, c.symbol_id, c.ref, c.path, c.start_line, c.content, c.summary, c.qualified_name, s.name,
  coalesce(c.chunk_type IN ('function', 'method'), false) AS is_complete, coalesce(c.chunk_type IN ('function', 'method', 'class'), false) AS is_symbol
  FROM sy JOIN c ON c.symbol_id = sy.id JOIN s ON s.id = sy.id),
co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ref ORDER BY score DESC, is_complete DESC, is_symbol DESC, start_line, id) AS n1 FROM ca) WHERE n1 = 1),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM co)"""


def _ranked(spark, folder):
    cards = R.collapse_by_ref(_cards(spark, folder).withColumn("is_complete", F.coalesce("is_complete", F.lit(False))).withColumn("is_symbol", F.coalesce("is_symbol", F.lit(False))))
    return R.top_k(cards, 1 << 30, [F.desc("score"), F.col("id")])


@query("collapse_by_ref", f"{_W}, {_CARDS} SELECT query_id, ref, id, score FROM co")
def collapse_by_ref(spark, folder):
    return _ranked(spark, folder).select("query_id", "ref", "id", "score")


@query("context_pack", f"{_W}, {_CARDS} SELECT query_id, id, CAST(rank AS INT) AS rank, CAST(used AS BIGINT) AS used FROM (SELECT query_id, id, rank, sum(CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM ra) WHERE used <= 4000 - 220")
def context_pack(spark, folder):
    """Cards of each query that fit a budget of 4,000 tokens."""
    cards = _ranked(spark, folder).withColumn("n_tokens", T.token_count(F.col("content")))
    return R.token_budget(cards, 4000).select("query_id", "id", "rank", "used")


#: What cards carry, and what queries ask for in their own case.
_CARRIED = f"""tm AS (SELECT query_id, id, rank, score, is_symbol, lower(name) AS lname, {_terms("concat_ws(' ', name, summary, qualified_name)")} AS terms FROM ra),
qc AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(coalesce(query, ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3 AND lower(x) NOT IN ({_STOP}))) AS asked FROM q)"""


@query(
    "confidence",
    f"""{_W}, {_CARDS}, {_CARRIED}, f5 AS (SELECT * FROM tm WHERE rank <= 5), pe AS (SELECT query_id, count(*) AS n, list_distinct(flatten(list(terms))) AS carried FROM f5 GROUP BY 1),
    cu AS (SELECT query_id, max((c, lname))[2] AS cname, max(c) AS c FROM (SELECT query_id, lname, count(*) AS c FROM f5 WHERE lname IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    jd AS (SELECT qc.query_id, asked, n, c, cname, list_sort(list_filter(asked, lambda x: NOT list_contains(coalesce(carried, []), x))) AS miss FROM qc LEFT JOIN pe USING (query_id) LEFT JOIN cu USING (query_id)),
    lo AS (SELECT *, coalesce(len(asked) >= 2 AND c >= 2 AND c / n >= 0.6 AND len(miss) > 0, false) AS low FROM jd)
    SELECT query_id, CASE WHEN low THEN 'low' ELSE 'high' END AS confidence, CASE WHEN low THEN cname END AS clustered_on, CASE WHEN n IS NULL OR len(asked) < 2 THEN [] ELSE miss END AS missing FROM lo""",
)
def confidence(spark, folder):
    """Whether the first cards answer their query."""
    return R.assess_confidence(_ranked(spark, folder), _queries(spark, folder))


@query(
    "coverage_rerank",
    f"""{_W}, {_CARDS}, {_CARRIED}, bl AS (SELECT query_id, id, round(len(list_intersect(asked, terms)) / greatest(len(asked), 1) + 0.4::DOUBLE * (score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS blended
      FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM tm) JOIN qc USING (query_id))
    SELECT query_id, id, blended, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, id) AS INT) AS rank FROM bl""",
)
def coverage_rerank(spark, folder):
    """Cards reordered by the query terms they carry."""
    return R.rerank_by_coverage(_ranked(spark, folder), _queries(spark, folder)).select("query_id", "id", "blended", "rank")


#: BM25 over the cards: their text, summary and path.
_CARD_BM25 = _BM25.replace("SELECT doc_id AS id,", "SELECT id,").replace("FROM documents", "FROM ct").replace("rn <= 20", "rn <= 40")


@query(
    "find_tests",
    f"""{_W}, {_ASKED}, ct AS (SELECT id, path, concat_ws(' ', content, summary, path) AS text FROM c), {_CARD_BM25}
    SELECT query_id, path, max(round(score, 6)) AS score FROM bm JOIN ct USING (id) WHERE regexp_matches(lower(path), '^tests?/|/tests?/') GROUP BY 1, 2""",
)
def find_tests(spark, folder):
    """Test files among the 40 best cards by words of each query."""
    cards = base.chunk_texts(spark, folder).select("id", "path", F.concat_ws(" ", "content", "summary", "path").alias("text"))
    hits = R.bm25(cards, _queries(spark, folder), k=40).join(cards.select("id", "path"), "id")
    return hits.where(F.lower("path").rlike("^tests?/|/tests?/")).groupBy("query_id", "path").agg(F.max(F.round("score", 6)).alias("score"))
