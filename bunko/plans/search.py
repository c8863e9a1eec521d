"""Retrieval queries (BM25, dense, fusion, grep)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.operators import search
from bunko.session import scratch, table

ASKED = [(1, "refresh lag of the old system"), (2, "stock refill design note"), (3, "運用係 受領一覧 検証"), (4, "Testumgebung Bericht"), (5, "the the report of the auditor")]
EACH = 100
PATTERN = "(?i)(auditor|監査役|Prüfstelle)"


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "qid bigint, query string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def _shape(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank0").cast("bigint").alias("rank0"))


def _kept() -> Column:
    return F.lower(F.coalesce("source", F.lit(""))).contains("drive") & F.lower(F.coalesce("lang", F.lit(""))).contains("en")


def _near_shape(near: DataFrame) -> DataFrame:
    return near.select("qid", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"), F.col("rank0").cast("bigint").alias("rank0"))


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.build(_docs(spark, sf_dir), "doc_id", "text")


def _kept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(_kept()).select(F.col("doc_id").alias("id"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(search.bm25(_index(spark, sf_dir), _asked(spark), 8))


def bm25_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(search.bm25(_index(spark, sf_dir), _asked(spark), 8, _kept_ids(spark, sf_dir)))


def bm25_search_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_search, on an index that was written to a folder and is read back."""
    path = scratch(spark, "index")
    _index(spark, sf_dir).save(path)
    return _shape(search.bm25(search.Index.load(spark, path), _asked(spark), 8))


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return index.totals.select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(index.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings")))


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "project", "category", "filetype", F.col("source").alias("mount"))
    return search.matches(docs, category="分析", filetype=" .MD, txt,pdf ,docx", mount="DRIVE").select("doc_id")


def bm25_term_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all terms the frequent ones, as its SQL has it."""
    return bm25_term_stats_all(spark, sf_dir).where("df >= 20")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors, vectors.where("id IN (1, 2, 3, 4, 5)").select(F.col("id").alias("qid"), F.col("v").alias("q"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_shape(search.dense(*_vectors(spark, sf_dir), 10))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = search.bm25(_index(spark, sf_dir), _asked(spark), search.POOL)
    return _shape(search.fuse(lexical, search.dense(*_vectors(spark, sf_dir)), 20))


# The searches with every row whose id is divisible by EACH as a query, against all rows.


def _every_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("doc_id") % EACH == 0).select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))


def _every_vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _vectors(spark, sf_dir)[0]
    return vectors, vectors.where(F.col("id") % EACH == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def _every_found(spark: SparkSession, sf_dir: str, k: int, kept: Column) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", kept.alias("kept"))
    return search.bm25_many(docs, _every_asked(spark, sf_dir), k)


def bm25_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(_every_found(spark, sf_dir, 8, F.lit(True)))


def bm25_search_filtered_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(_every_found(spark, sf_dir, 8, _kept()))


def dense_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_shape(search.dense(*_every_vector(spark, sf_dir), 10))


def rrf_fusion_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = _every_found(spark, sf_dir, search.POOL, F.lit(True))
    return _shape(search.fuse(lexical, search.dense(*_every_vector(spark, sf_dir)), 20))


def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_lines(search.grep(_docs(spark, sf_dir), "doc_id", "text", PATTERN), 100).withColumnRenamed("id", "doc_id")


def grep_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = search.grep(docs, "doc_id", "text", PATTERN).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"))
    return docs.join(found, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"))


QUERIES = {f.__name__: f for f in (bm25_search, bm25_search_filtered, bm25_search_loaded, index_totals, masked_documents, bm25_term_stats, bm25_term_stats_all, dense_topk, rrf_fusion, bm25_search_all, bm25_search_filtered_all, dense_topk_all, rrf_fusion_all, grep_lines, grep_count_by_source)}

# Terms told apart without look-arounds: runs of ideographs and kana are taken out, cut into neighbours by position.
_RUNS = r"regexp_extract_all(lower({0}), '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}ー]+')"
_TOKENS = (
    r"list_concat(list_concat(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}ー]+', ' ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), "
    r"flatten(list_transform(" + _RUNS + r", lambda r: list_transform(range(1, greatest(length(r), 2)), lambda i: substr(r, i, 2))))), "
    r"list_transform(regexp_extract_all({0}, '[A-Za-z0-9_.\-]{{2,}}'), lambda x: lower(x)))"
)
_BM25 = (
    "WITH q(qid, query) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in ASKED) + "), "
    "tok AS (SELECT doc_id, " + _TOKENS.format("text") + " AS t FROM documents), "
    "p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL), "
    "dl AS (SELECT doc_id, coalesce(len(t), 0) AS dl FROM tok), "
    "raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p GROUP BY term), "
    "idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw), "
    "a AS (SELECT qid, unnest(" + _TOKENS.format("query") + ") AS term FROM q), "
    "s AS (SELECT qid, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))) AS score FROM a JOIN p USING (term) JOIN idf USING (term) JOIN dl USING (doc_id) GROUP BY ALL), "
)
_RANKED = "r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank0 FROM s {0}) "
_PICK = "SELECT qid::BIGINT AS qid, doc_id, round(score, 6) AS score, rank0 FROM r WHERE rank0 < 8 AND score > 0"
_DENSE = "SELECT a.vec_id AS qid, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (1, 2, 3, 4, 5)"
_LINES = "SELECT doc_id, source, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) AS line_no FROM documents"
ORACLES = {
    "bm25_search": _BM25 + _RANKED.format("") + _PICK,
    "bm25_search_filtered": _BM25 + _RANKED.format("JOIN documents USING (doc_id) WHERE lower(coalesce(source, '')) LIKE '%drive%' AND lower(coalesce(lang, '')) LIKE '%en%'") + _PICK,
    "bm25_term_stats": _BM25 + "z AS (SELECT 1) SELECT term, df, round(idf, 6) AS idf FROM idf WHERE df >= 20",
    "dense_topk": f"SELECT qid, vec_id, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) - 1 AS rank0 FROM ({_DENSE}) QUALIFY rank0 < 10",
    "bm25_search_loaded": _BM25 + _RANKED.format("") + _PICK,
    "index_totals": _BM25 + "z AS (SELECT 1) SELECT (SELECT count(*) FROM documents) AS n, (SELECT round(avg(dl), 6) FROM dl) AS avgdl, count(*) AS n_terms, sum(df) AS n_postings FROM idf",
    "masked_documents": "SELECT doc_id FROM documents WHERE category LIKE '%分析%' AND source ILIKE '%drive%' AND ltrim(lower(trim(filetype)), '.') IN ('md', 'txt', 'pdf', 'docx')",
    "rrf_fusion": _BM25
    + _RANKED.format("")
    + f", d AS (SELECT qid, vec_id AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) - 1 AS rank0 FROM ({_DENSE})), "
    "f AS (SELECT qid, doc_id, round(coalesce(1.0::DOUBLE / (60 + a.rank0), 0) + coalesce(1.0::DOUBLE / (60 + b.rank0), 0), 6) AS score FROM (SELECT * FROM r WHERE rank0 < 200 AND score > 0) a FULL JOIN (SELECT * FROM d WHERE rank0 < 200) b USING (qid, doc_id)) "
    "SELECT qid::BIGINT AS qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) - 1 AS rank0 FROM f QUALIFY rank0 < 20",
    "grep_lines": f"SELECT doc_id, line_no::INT AS line_no, substr(trim(line, ' '), 1, 220) AS line FROM ({_LINES}) WHERE regexp_matches(line, '{PATTERN}') ORDER BY doc_id, line_no LIMIT 100",
    "grep_count_by_source": f"SELECT source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM ({_LINES}) WHERE regexp_matches(line, '{PATTERN}') GROUP BY source",
}


def _every(sql: str) -> str:
    """The oracle with every EACH-th row as a query."""
    literals = _BM25[len("WITH q(qid, query) AS (") : _BM25.index("), tok AS")]
    return sql.replace(literals, f"SELECT doc_id, text FROM documents WHERE doc_id % {EACH} = 0").replace("a.vec_id IN (1, 2, 3, 4, 5)", f"a.vec_id % {EACH} = 0")


ORACLES |= {f"{k}_all": _every(ORACLES[k]) for k in ("bm25_search", "bm25_search_filtered", "dense_topk", "rrf_fusion")}
ORACLES["bm25_term_stats_all"] = _BM25 + "z AS (SELECT 1) SELECT term, df, round(idf, 6) AS idf FROM idf"
