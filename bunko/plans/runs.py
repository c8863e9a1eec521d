"""Queries on run logs, the question cache, events and the tabular tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.functions import text as fn
from bunko.operators import runs
from bunko.session import table
from bunko.streaming import windows


def _events(spark: SparkSession, d: str) -> DataFrame:
    return runs.unique_events(table(spark, d, "chain_events"))


def _on(f):
    return lambda spark, d: f(_events(spark, d))


def chain_unique(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("run_id", "q_index", "seq", "type", "tool", "turn")


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """Progress of each run: questions, answered ones, tokens and seconds."""
    s = runs.summaries(_events(spark, d))
    return s.groupBy("run_id").agg(F.count("*").alias("n_questions"), F.count_if(F.col("answer_seq").isNotNull()).alias("n_answered"), F.sum("total_tokens").alias("total_tokens"), F.max("turns").alias("most_turns"))


def route_counts(spark: SparkSession, d: str) -> DataFrame:
    return runs.routes(_events(spark, d)).groupBy("route").agg(F.count("*").alias("n"))


def slow_streaks(spark: SparkSession, d: str) -> DataFrame:
    return runs.slow_streaks(_events(spark, d), 2.0, 3)


def late_events(spark: SparkSession, d: str) -> DataFrame:
    return runs.late_events(_events(spark, d), 24)


def ask_latest(spark: SparkSession, d: str) -> DataFrame:
    return runs.latest_asks(table(spark, d, "ask_cache"))


def engine_comparison(spark: SparkSession, d: str) -> DataFrame:
    return runs.engine_comparison(table(spark, d, "ask_cache"))


def answers_clipped(spark: SparkSession, d: str) -> DataFrame:
    asks = table(spark, d, "ask_cache")
    return asks.select("ask_id", fn.clip(F.col("answer"), 40).alias("short"), fn.middle_out(F.col("evidence"), 60).alias("evidence"))


def answer_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ask_cache").where("answer IS NOT NULL").select("ask_id", F.size(fn.numbers(F.col("answer"))).cast("bigint").alias("n"), F.round(F.aggregate(fn.numbers(F.col("answer")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def answers_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Answers in the form in which they are compared, for those that are equal but differ as stored."""
    n = table(spark, d, "ask_cache").where("answer IS NOT NULL").select(fn.normalize_answer(F.col("answer")).alias("form"), "answer")
    return n.groupBy("form").agg(F.countDistinct("answer").alias("n_written"), F.count("*").alias("n")).where("n_written > 1")


def markup_stripped(spark: SparkSession, d: str) -> DataFrame:
    """The stripped text of every document; null stays null."""
    docs = table(spark, d, "documents").select("doc_id", fn.strip_markup(F.col("text")).alias("text"))
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "1 hour")


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(table(spark, d, "events"), "1 day", "6 hours")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"), "30 minutes")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The hourly windows again, as a stream over the table's files with a watermark."""
    return windows.streamed_tumbling(spark, d, "events", "1 hour")


def chain_stream(spark: SparkSession, d: str) -> DataFrame:
    """Unique events by type, de-duplicated by a stream with a watermark on their arrival."""
    return windows.streamed_unique(spark, d, "chain_events", runs.KEY)


def late_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events by ten minutes and type as they come in four slices, those more than twenty minutes late for their window
    dropped."""
    events = _events(spark, d).where("arrived_at IS NOT NULL").withColumn("at", F.timestamp_seconds(F.floor("t")))
    return windows.replayed_tumbling(events, "at", "type", "arrived_at", 4, "10 minutes", "20 minutes")


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_suppliers"))


def order_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in "FOP"))


def top_customers_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """The three customers of each nation with the largest order totals."""
    from pyspark.sql import Window

    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    rows = table(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rank = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("spent"), "c_custkey"))
    return rows.withColumn("rank", rank).where("rank <= 3").select("n_name", F.col("rank").cast("bigint").alias("rank"), "c_custkey", F.col("spent").cast("double").alias("spent"))


QUERIES = {
    "chain_unique": chain_unique, "chain_summary": _on(runs.summaries), "chain_tool_paths": _on(runs.tool_paths), "event_pairing": _on(runs.pairs), "tool_usage": _on(runs.tool_usage), "run_latest_wins": _on(runs.latest_answers),
} | {f.__name__: f for f in (run_totals, route_counts, slow_streaks, late_events, ask_latest, engine_comparison, answers_clipped, answer_numbers, answers_normalized, markup_stripped, event_windows, event_sliding, event_sessions, event_stream, chain_stream, late_stream, pricing_summary, order_pivot, top_customers_by_nation)}

_E = "WITH e AS (SELECT * FROM chain_events QUALIFY row_number() OVER (PARTITION BY run_id, q_index, seq ORDER BY arrived_at) = 1)"
_S = "SELECT run_id, q_index, max(turn) AS turns, round(sum(latency_sec), 3) AS latency_sec, sum(total_tokens) AS total_tokens, round(max(t) - min(t), 2) AS elapsed_sec, count(*) FILTER (type = 'tool_call') AS n_calls, max(seq) FILTER (type = 'answer') AS answer_seq, count(*) AS n_events FROM e GROUP BY run_id, q_index"
_WINDOW = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"
_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"
ORACLES = {
    "chain_unique": _E + " SELECT run_id, q_index, seq, type, tool, turn FROM e",
    "chain_summary": f"{_E} {_S}",
    "chain_tool_paths": _E + " SELECT run_id, q_index, string_agg(tool, ' → ' ORDER BY seq) AS tool_path FROM e WHERE type = 'tool_call' AND tool IS NOT NULL GROUP BY run_id, q_index",
    "event_pairing": _E + ", n AS (SELECT *, row_number() OVER (PARTITION BY run_id, q_index, type, tool ORDER BY seq) AS nth FROM e WHERE tool IS NOT NULL AND type IN ('tool_call', 'tool_result')) SELECT c.run_id, c.q_index, c.tool, c.seq AS call_seq, r.seq AS result_seq, round(r.t - c.t, 2) AS seconds, r.seq IS NULL AS pending FROM n c LEFT JOIN n r ON r.type = 'tool_result' AND c.run_id = r.run_id AND c.q_index = r.q_index AND c.tool = r.tool AND c.nth = r.nth WHERE c.type = 'tool_call'",
    "tool_usage": _E + " SELECT tool, count(*) AS n_calls, count(DISTINCT (run_id, q_index)) AS n_questions FROM e WHERE type = 'tool_call' AND tool IS NOT NULL GROUP BY tool",
    "run_latest_wins": _E + " SELECT q_index, run_id, round(t, 3) AS t FROM e WHERE type = 'answer' QUALIFY row_number() OVER (PARTITION BY q_index ORDER BY e.t DESC, run_id) = 1",
    "run_totals": f"{_E}, s AS ({_S}) SELECT run_id, count(*) AS n_questions, count(answer_seq) AS n_answered, sum(total_tokens) AS total_tokens, max(turns) AS most_turns FROM s GROUP BY run_id",
    "route_counts": _E + ", r AS (SELECT run_id, q_index, CASE " + " ".join(f"WHEN bool_or(type = 'tool_call' AND tool IS NOT DISTINCT FROM '{t}') THEN '{n}'" for n, t in runs.ROUTES) + " ELSE 'none' END AS route FROM e GROUP BY run_id, q_index) SELECT route, count(*) AS n FROM r GROUP BY route",
    "slow_streaks": _E + ", m AS (SELECT run_id, q_index, seq, latency_sec, latency_sec > 2 AS slow FROM e WHERE type = 'llm_response' AND latency_sec IS NOT NULL), b AS (SELECT *, CASE WHEN slow = lag(slow) OVER w THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY run_id, q_index ORDER BY seq)), i AS (SELECT *, sum(new) OVER (PARTITION BY run_id, q_index ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM b) SELECT run_id, q_index, count(*) AS n, min(seq) AS from_seq, max(seq) AS to_seq, round(max(latency_sec), 3) AS slowest FROM i WHERE slow GROUP BY run_id, q_index, island HAVING count(*) >= 3",
    "late_events": _E + " SELECT type, count(*) AS n, count(*) FILTER (epoch_us(arrived_at) / 1e6 - t > 86400) AS n_late FROM e GROUP BY type",
    "ask_latest": "SELECT md5, question, engine, substr(md5(question), 1, 12) AS question_key, ask_id, answer, confident, error, latency_sec, count(*) OVER (PARTITION BY md5, question, engine) AS n_asked FROM ask_cache WHERE md5 IS NOT NULL AND engine IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5, question, engine ORDER BY asked_at DESC, ask_id DESC) = 1",
    "engine_comparison": "SELECT engine, count(*) AS n, count(*) FILTER (error IS NULL AND regexp_matches(coalesce(answer, ''), '\\S')) AS n_ok, round(avg(latency_sec), 4) AS mean_sec, floor(avg(length(answer)) FILTER (error IS NULL AND regexp_matches(coalesce(answer, ''), '\\S')))::BIGINT AS mean_chars, count(*) FILTER (confident) AS n_confident, count(DISTINCT md5) AS n_images FROM ask_cache GROUP BY engine",
    "answers_clipped": f"SELECT ask_id, CASE WHEN length({_FLAT.format('answer')}) > 40 THEN substr({_FLAT.format('answer')}, 1, 39) || '…' ELSE {_FLAT.format('answer')} END AS short, CASE WHEN length(evidence) > 60 THEN substr(evidence, 1, 39) || chr(10) || '... [' || (length(evidence) - 60) || ' characters left out] ...' || chr(10) || right(evidence, 21) ELSE evidence END AS evidence FROM ask_cache",
    "event_windows": _WINDOW,
    "event_stream": _WINDOW,
    "event_sliding": "WITH x AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) - to_hours(6 * k) AS window_start FROM events, range(4) r(k)) SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM x GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k",
    "chain_stream": _E + " SELECT type, count(*) AS n FROM e GROUP BY type",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "order_pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "top_customers_by_nation": "WITH s AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18, 2)) AS spent FROM orders GROUP BY 1) SELECT n_name, row_number() OVER (PARTITION BY n_name ORDER BY spent DESC, c_custkey) AS rank, c_custkey, spent::DOUBLE AS spent FROM customer JOIN s ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey QUALIFY rank <= 3",
}
ORACLES["late_stream"] = (
    _E + ", x AS (SELECT type, floor(t)::BIGINT AS s, epoch_us(arrived_at) AS a FROM e WHERE arrived_at IS NOT NULL), "
    "m AS (SELECT min(a) AS lo, max(a) AS hi FROM x), b AS (SELECT type, s, least(floor((a - lo) * 4.0 / greatest(hi - lo, 1)), 3)::INT AS k FROM x, m), "
    "w AS (SELECT k, max(max(s)) OVER (ORDER BY k) - 1200 AS mark FROM b GROUP BY k), l AS (SELECT b.*, (SELECT max(mark) FROM w WHERE w.k < b.k) AS mark FROM b) "
    "SELECT make_timestamp(s // 600 * 600 * 1000000) AS window_start, type, count(*) AS n FROM l WHERE mark IS NULL OR (s // 600 + 1) * 600 > mark GROUP BY ALL"
)
