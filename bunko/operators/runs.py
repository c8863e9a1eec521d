"""Logs of question-answering runs: de-duplicated events, summaries, pairing, routes, breaker, latest answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id", "q_index", "seq"]
QUESTION = ["run_id", "q_index"]
ROUTES = [("vision", "read_image"), ("table", "tables"), ("code", "run_python"), ("compare", "diff"), ("search", "search"), ("read", "read_doc")]


def unique_events(events: DataFrame) -> DataFrame:
    """One row per (run_id, q_index, seq), the first to arrive; repeated rows collapse before the exchange."""
    values = [c for c in events.columns if c not in KEY]
    first = events.groupBy(*KEY).agg(F.min(F.struct("arrived_at", *(c for c in values if c != "arrived_at"))).alias("e"))
    return first.select(*KEY, *(F.col(f"e.{c}").alias(c) for c in values))


def summaries(events: DataFrame) -> DataFrame:
    """Per question: turns, latency, tokens, elapsed seconds, tool calls, and whether and when it was answered."""
    return events.groupBy(*QUESTION).agg(
        F.max("turn").alias("turns"), F.round(F.sum("latency_sec"), 3).alias("latency_sec"), F.sum("total_tokens").alias("total_tokens"), F.round(F.max("t") - F.min("t"), 2).alias("elapsed_sec"),
        F.count_if(F.col("type") == "tool_call").alias("n_calls"), F.max(F.when(F.col("type") == "answer", F.col("seq"))).alias("answer_seq"), F.count("*").alias("n_events"),
    )


def tool_paths(events: DataFrame) -> DataFrame:
    """Per question the tools called, in order; a question's calls are bounded by its turns."""
    calls = events.where("type = 'tool_call' AND tool IS NOT NULL")
    path = F.array_sort(F.collect_list(F.struct("seq", "tool")))
    return calls.groupBy(*QUESTION).agg(F.array_join(F.transform(path, lambda x: x["tool"]), " → ").alias("tool_path"))


def pairs(events: DataFrame) -> DataFrame:
    """Tool calls with the result that belongs to each: the n-th result of a tool to its n-th call in the question."""
    nth = F.row_number().over(Window.partitionBy(*QUESTION, "tool").orderBy("seq"))
    side = lambda kind, seq, t: events.where((F.col("type") == kind) & F.col("tool").isNotNull()).withColumn("nth", nth).select(*QUESTION, "tool", "nth", F.col("seq").alias(seq), F.col("t").alias(t))
    both = side("tool_call", "call_seq", "call_t").join(side("tool_result", "result_seq", "result_t"), [*QUESTION, "tool", "nth"], "left")
    return both.select(*QUESTION, "tool", "call_seq", "result_seq", F.round(F.col("result_t") - F.col("call_t"), 2).alias("seconds"), F.col("result_seq").isNull().alias("pending"))


def routes(events: DataFrame) -> DataFrame:
    """(run_id, q_index, route): the first rule whose tool was used, else `none`."""
    used = events.groupBy(*QUESTION).agg(*(F.max((F.col("type") == "tool_call") & F.col("tool").eqNullSafe(tool)).alias(tool) for _, tool in ROUTES))
    return used.select(*QUESTION, F.coalesce(*(F.when(F.col(tool), name) for name, tool in ROUTES), F.lit("none")).alias("route"))


def tool_usage(events: DataFrame) -> DataFrame:
    calls = events.where("type = 'tool_call' AND tool IS NOT NULL")
    return calls.groupBy("tool").agg(F.count("*").alias("n_calls"), F.countDistinct("run_id", "q_index").alias("n_questions"))


def latest_answers(events: DataFrame) -> DataFrame:
    """(q_index, run_id, t): of all runs the last answer to each question; of equal times the earlier run's."""
    answers = events.where("type = 'answer'")
    best = answers.groupBy("q_index").agg(F.max(F.col("t")).alias("t"))
    return answers.join(best, ["q_index", "t"]).groupBy("q_index", "t").agg(F.min("run_id").alias("run_id")).select("q_index", "run_id", F.round("t", 3).alias("t"))


def slow_streaks(events: DataFrame, limit: float, least: int) -> DataFrame:
    """Islands of at least `least` responses in a row, within a question, that took longer than the limit."""
    order = Window.partitionBy(*QUESTION).orderBy("seq")
    marked = events.where("type = 'llm_response' AND latency_sec IS NOT NULL").withColumn("slow", F.col("latency_sec") > limit)
    island = F.sum(F.when(F.col("slow") == F.lag("slow").over(order), 0).otherwise(1)).over(order)
    rows = marked.withColumn("island", island).where("slow")
    return rows.groupBy(*QUESTION, "island").agg(F.count("*").alias("n"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.round(F.max("latency_sec"), 3).alias("slowest")).where(F.col("n") >= least).drop("island")


def late_events(events: DataFrame, hours: int) -> DataFrame:
    """Number of events by type that arrived more than some hours after they happened."""
    late = F.unix_micros(F.col("arrived_at").cast("timestamp")) / 1e6 - F.col("t") > hours * 3600
    return events.groupBy("type").agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"))


def latest_asks(asks: DataFrame) -> DataFrame:
    """The cache: per image, question and engine the last asked; few images have very many questions, so keys are whole."""
    last = asks.where("md5 IS NOT NULL AND engine IS NOT NULL").groupBy("md5", "question", "engine").agg(F.max(F.struct("asked_at", "ask_id", "answer", "confident", "error", "latency_sec")).alias("a"), F.count("*").alias("n_asked"))
    return last.select("md5", "question", "engine", F.substring(F.md5(F.col("question").cast("binary")), 1, 12).alias("question_key"), "a.ask_id", "a.answer", "a.confident", "a.error", "a.latency_sec", "n_asked")


def engine_comparison(asks: DataFrame) -> DataFrame:
    ok = F.col("error").isNull() & F.coalesce("answer", F.lit("")).rlike(r"\S")
    return asks.groupBy("engine").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg("latency_sec"), 4).alias("mean_sec"), F.floor(F.avg(F.when(ok, F.length("answer")))).alias("mean_chars"),
        F.count_if("confident").alias("n_confident"), F.countDistinct("md5").alias("n_images"),
    )
