"""Queries that go through files: tables written in another form and read back, listings, decoded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.operators import runs
from bunko.sources import files, records
from bunko.session import scratch, table


def chain_from_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """The event log written as JSON lines and read back."""
    events, path = table(spark, d, "chain_events"), scratch(spark, "lines")
    events.write.json(path)
    return records.read_json_lines(spark, path, events.schema).groupBy("run_id", "type").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("latency_sec"), 3).alias("seconds"))


def asks_from_values(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers written as separated values and read back, line breaks in them kept."""
    asks, path = table(spark, d, "ask_cache").select("ask_id", "question", "answer"), scratch(spark, "values")
    records.write_values(asks, path)
    rows = records.read_values(spark, path, asks.schema)
    return rows.select("ask_id", F.md5(F.col("question").cast("binary")).alias("question_md5"), F.length(F.coalesce("answer", F.lit(""))).alias("n_chars"))


def latest_from_store(spark: SparkSession, d: str) -> DataFrame:
    """The question cache filled in two turns, with the latest row of each key."""
    store = records.LatestStore(scratch(spark, "store"), ["md5", "question", "engine"], ["asked_at", "ask_id"])
    asks = table(spark, d, "ask_cache").where("md5 IS NOT NULL AND engine IS NOT NULL").select("md5", "question", "engine", "asked_at", "ask_id", "confident")
    store.put(asks.where("ask_id % 2 = 0"))
    store.put(asks.where("ask_id % 2 = 1"))
    return store.get(spark).select("md5", "question", "engine", "ask_id", "confident")


def unseen_texts(spark: SparkSession, d: str) -> DataFrame:
    """Contents of documents that a store of the pages' contents does not hold, each once."""
    store = records.LatestStore(scratch(spark, "store"), ["text_md5"], ["at"])
    key = F.md5(F.col("text").cast("binary")).alias("text_md5")
    store.put(table(spark, d, "documents").where("text IS NOT NULL AND doc_id % 3 = 0").select(key, F.col("added_at").alias("at")))
    return store.missing(table(spark, d, "documents").where("text IS NOT NULL").groupBy(key).agg(F.min("doc_id").alias("doc_id")))


def decoded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files with a byte order mark, decoded and made pages."""
    raw = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "filetype", F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary")).alias("content"))
    text = raw.select("doc_id", "filetype", files.decoded("content").alias("d")).select("doc_id", "d.encoding", files.plain_page(F.col("d.text"), F.coalesce("filetype", F.lit(""))).alias("p"))
    return text.select("doc_id", "encoding", "p.n_chars", "p.n_lines", "p.truncated", F.length("p.text").alias("n_shown"))


def tabular_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as separated values: rows and columns."""
    rows = table(spark, d, "documents").where("text IS NOT NULL AND instr(text, '\"') = 0").select("doc_id", files.tabular_preview("\t")("text").alias("t"))
    return rows.select("doc_id", F.col("t.n_rows").alias("n_rows"), F.size("t.columns").alias("n_columns"), F.size("t.rows").alias("n_shown"), "t.truncated")


def listed_tables(spark: SparkSession, d: str) -> DataFrame:
    """The files of the tables."""
    return files.listed(spark, d).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "reason")


def run_peek(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last event of each question."""
    events = runs.unique_events(table(spark, d, "chain_events"))
    return events.groupBy("run_id", "q_index").agg(F.min_by("type", "seq").alias("first_type"), F.max_by("type", "seq").alias("last_type"), F.max("seq").alias("last_seq"))


QUERIES = {f.__name__: f for f in (chain_from_json_lines, asks_from_values, latest_from_store, unseen_texts, decoded_documents, tabular_documents, listed_tables, run_peek)}

_EVENTS = "(SELECT * FROM chain_events QUALIFY row_number() OVER (PARTITION BY run_id, q_index, seq ORDER BY arrived_at) = 1)"
_FENCED = " ".join(f"WHEN '{k}' THEN {len(v) + 8}" for k, v in files.FENCES.items())
ORACLES = {
    "chain_from_json_lines": "SELECT run_id, type, count(*) AS n, sum(total_tokens)::BIGINT AS tokens, round(sum(latency_sec), 3) AS seconds FROM chain_events GROUP BY ALL",
    "asks_from_values": "SELECT ask_id, md5(question) AS question_md5, length(coalesce(answer, ''))::INT AS n_chars FROM ask_cache",
    "latest_from_store": "SELECT md5, question, engine, ask_id, confident FROM ask_cache WHERE md5 IS NOT NULL AND engine IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5, question, engine ORDER BY asked_at DESC, ask_id DESC) = 1",
    "unseen_texts": "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (doc_id % 3 = 0) = 0",
    "decoded_documents": f"SELECT doc_id, 'utf-8-sig' AS encoding, length(text)::INT AS n_chars, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS n_lines, length(text) > 400000 AS truncated, (length(text) + CASE ltrim(lower(coalesce(filetype, '')), '.') {_FENCED} ELSE 0 END)::INT AS n_shown FROM documents WHERE text IS NOT NULL",
    "run_peek": f"SELECT run_id, q_index, arg_min(type, seq) AS first_type, arg_max(type, seq) AS last_type, max(seq) AS last_seq FROM {_EVENTS} GROUP BY ALL",
}
