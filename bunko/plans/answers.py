"""Queries on answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.functions import text as fn
from bunko.operators import answers as ops
from bunko.operators import runs
from bunko.session import table

DEFAULT = "no answer"


def _asks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ask_cache")


def answer_agreement(spark: SparkSession, d: str) -> DataFrame:
    return ops.successive(_asks(spark, d)).select("ask_id", "before_id", "same", "same_elements", "agree")


def answer_forms(spark: SparkSession, d: str) -> DataFrame:
    return ops.distinct_forms(_asks(spark, d))


def answer_lines(spark: SparkSession, d: str) -> DataFrame:
    return _asks(spark, d).select("ask_id", fn.one_line(F.col("answer")).alias("line"), F.size(fn.elements(F.col("answer"))).cast("bigint").alias("n_elements"), fn.token_estimate(F.col("answer")).alias("tokens"))


def _answered(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the runs with the latency of their answers as text, where there is one."""
    events = runs.unique_events(table(spark, d, "chain_events"))
    return events.where("type = 'answer'").groupBy("run_id", "q_index").agg(F.max(F.struct("seq", "latency_sec")).alias("a")).select("run_id", "q_index", F.round("a.latency_sec", 2).cast("string").alias("answer"))


def answers_with_default(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "chain_events").select("run_id", "q_index").distinct()
    rows = ops.with_default(questions, _answered(spark, d), ["run_id", "q_index"], DEFAULT)
    return rows.select("run_id", "q_index", F.when(F.col("missing"), DEFAULT).otherwise("given").alias("answer"), "missing")


def answer_violations(spark: SparkSession, d: str) -> DataFrame:
    """The image questions' answers, keyed by the last digits of their ids, against the keys 0 to 999 and -1."""
    asks = _asks(spark, d).select(F.when(F.col("ask_id") % 13 == 0, F.concat(F.lit("q"), F.col("ask_id") % 1000)).otherwise((F.col("ask_id") % 1000).cast("string")).alias("key"), "answer")
    expected = spark.range(-1, 1000).select(F.col("id").alias("key"))
    return ops.violations(asks, expected, "key", 60)


def evidence_excerpts(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.excerpts(_asks(spark, d), 60, 10)
    return rows.select("md5", "n_evidence", F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5"))


def ask_batches(spark: SparkSession, d: str) -> DataFrame:
    return ops.batch_statistics(_asks(spark, d), 20)


def engines_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ops.engines_by_type(_asks(spark, d), table(spark, d, "corpus_files"), 5)


def usage_by_tool(spark: SparkSession, d: str) -> DataFrame:
    events = runs.unique_events(table(spark, d, "chain_events"))
    usage = F.create_map(F.lit("tokens"), F.col("total_tokens").cast("double"), F.lit("seconds"), F.col("latency_sec"), F.lit("turns"), F.col("turn").cast("double"))
    return ops.merged_usage(events.select("type", usage.alias("usage")), ["type"], "usage")


def question_tools(spark: SparkSession, d: str) -> DataFrame:
    """Per question the distinct tools by name, and the number of calls of each."""
    calls = runs.unique_events(table(spark, d, "chain_events")).where("type = 'tool_call' AND tool IS NOT NULL").groupBy("run_id", "q_index", "tool").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "tool", "n")))
    return calls.groupBy("run_id", "q_index").agg(F.count("*").alias("n_tools"), F.sum("n").alias("n_calls"), F.array_join(parts, " ").alias("tools"))


def question_filter(spark: SparkSession, d: str) -> DataFrame:
    """Image questions with a keyword in question or answer, as it is written."""
    asks = _asks(spark, d).where(F.col("question").contains("report") | F.col("answer").contains("report"))
    return asks.groupBy("engine", F.coalesce("confident", F.lit(False)).alias("confident")).agg(F.count("*").alias("n"), F.min("ask_id").alias("first_id"))


def answer_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events by the hour they happened, as text, with the size of what they would carry."""
    at = F.date_format(F.timestamp_seconds(F.floor("t")), "yyyy-MM-dd HH:00")
    return table(spark, d, "chain_events").groupBy(at.alias("hour")).agg(F.count("*").alias("n"), F.sum(F.floor(F.coalesce("total_tokens", F.lit(0)) * 3 / 4)).alias("bytes"))


def encoded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as base64, and whether they come back."""
    code = F.base64(F.col("answer").cast("binary"))
    return _asks(spark, d).where("answer IS NOT NULL").select("ask_id", F.md5(F.regexp_replace(code, r"\s", "").cast("binary")).alias("code_md5"), (F.unbase64(code).cast("string") == F.col("answer")).alias("back"))


QUERIES = {f.__name__: f for f in (answer_agreement, answer_forms, answer_lines, answers_with_default, answer_violations, evidence_excerpts, ask_batches, engines_by_type, usage_by_tool, question_tools, question_filter, answer_hours, encoded_answers)}

_EVENTS = "(SELECT * FROM chain_events QUALIFY row_number() OVER (PARTITION BY run_id, q_index, seq ORDER BY arrived_at) = 1)"
_FULL, _HALF = fn._WIDE.replace("'", "''"), fn._NARROW.replace("'", "''")


def _commas(x: str) -> str:
    for _ in range(4):
        x = f"regexp_replace({x}, '(\\d),(\\d\\d\\d)(\\D|$)', '\\1\\2\\3', 'g')"
    return x


def _normal(x: str) -> str:
    plain = f"translate(regexp_replace(trim({x}, ' '), '…', '...', 'g'), '{_FULL}　 ：，、．％（）〜－―ー', '{_HALF}  :,,.%()~---')"
    return f"lower(regexp_replace({_commas(plain)}, '\\s+', '', 'g'))"


_WIDTHS = f"translate(regexp_replace(answer, '…', '...', 'g'), '{_FULL}', '{_HALF}')"
_OK = "error IS NULL AND regexp_matches(coalesce(answer, ''), '\\S')"
_KEYED = "(SELECT CASE WHEN ask_id % 13 = 0 THEN 'q' || ask_id % 1000 ELSE (ask_id % 1000)::VARCHAR END AS key, coalesce(answer, '') AS a FROM ask_cache)"
_NUM = "regexp_matches(key, '^-?\\d+$')"
ORACLES = {
    "answer_forms": f"SELECT {_normal('answer')} AS form, count(*) AS n FROM ask_cache WHERE answer IS NOT NULL GROUP BY 1",
    "answers_with_default": f"SELECT run_id, q_index, CASE WHEN x IS NULL THEN '{DEFAULT}' ELSE 'given' END AS answer, x IS NULL AS missing FROM (SELECT DISTINCT run_id, q_index FROM chain_events) LEFT JOIN (SELECT run_id, q_index, arg_max(coalesce(latency_sec::VARCHAR, ''), seq) AS y, nullif(y, '') AS x FROM {_EVENTS} WHERE type = 'answer' GROUP BY ALL) USING (run_id, q_index)",
    "answer_violations": f"WITH r AS {_KEYED}, s AS (SELECT key, count(*) AS n FROM r WHERE {_NUM} GROUP BY key), w AS (SELECT range::VARCHAR AS key FROM range(-1, 1000)) SELECT 'key is no integer' AS rule, key, count(*) AS n FROM r WHERE NOT {_NUM} GROUP BY key UNION ALL SELECT 'blank', key, count(*) FROM r WHERE {_NUM} AND NOT regexp_matches(a, '\\S') GROUP BY key UNION ALL SELECT 'line break', key, count(*) FROM r WHERE {_NUM} AND regexp_matches(a, '[\\r\\n]') GROUP BY key UNION ALL SELECT 'tab', key, count(*) FROM r WHERE {_NUM} AND contains(a, chr(9)) GROUP BY key UNION ALL SELECT 'too long', key, count(*) FROM r WHERE {_NUM} AND length(a) // 2 > 60 GROUP BY key UNION ALL SELECT 'repeated', key, n FROM s WHERE n > 1 UNION ALL SELECT 'missing', key, 1 FROM w WHERE key NOT IN (SELECT key FROM s) UNION ALL SELECT 'extra', key, n FROM s WHERE key NOT IN (SELECT key FROM w)",
    "evidence_excerpts": "SELECT md5, count(*) AS n_evidence, md5(string_agg(substr(evidence, 1, 60), chr(10) ORDER BY asked_at, ask_id)) AS excerpt_md5 FROM (SELECT * FROM ask_cache WHERE md5 IS NOT NULL AND regexp_matches(evidence, '\\S') QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY asked_at, ask_id) <= 10) GROUP BY md5",
    "ask_batches": f"SELECT engine, count(*) FILTER ({_OK}) AS done, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NULL AND NOT regexp_matches(coalesce(answer, ''), '\\S')) AS empty, coalesce(string_agg(error, ' / ' ORDER BY asked_at, ask_id) FILTER (e <= 20 AND error IS NOT NULL), '') AS first_errors FROM (SELECT *, row_number() OVER (PARTITION BY engine, error IS NULL ORDER BY asked_at, ask_id) AS e FROM ask_cache) GROUP BY engine",
    "engines_by_type": f"WITH r AS (SELECT a.*, coalesce(k.ext, '?') AS ext FROM ask_cache a LEFT JOIN (SELECT md5, min(lower(ext)) AS ext FROM corpus_files WHERE md5 IS NOT NULL GROUP BY md5) k USING (md5)) SELECT ext, engine, count(*) AS n, count(*) FILTER ({_OK}) AS n_ok, round(avg(latency_sec), 4) AS mean_sec, string_agg(ask_id::VARCHAR, ',' ORDER BY ask_id) FILTER (i <= 5) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY ext, engine ORDER BY ask_id) AS i FROM r) GROUP BY ext, engine",
    "usage_by_tool": " UNION ALL ".join(f"SELECT type, '{m}' AS measure, round(sum({c}), 3) AS amount FROM {_EVENTS} WHERE {c} IS NOT NULL GROUP BY type" for m, c in (("tokens", "total_tokens::DOUBLE"), ("seconds", "latency_sec"), ("turns", "turn::DOUBLE"))),
    "question_tools": f"SELECT run_id, q_index, count(*) AS n_tools, sum(n)::BIGINT AS n_calls, string_agg(tool || ':' || n, ' ' ORDER BY tool || ':' || n) AS tools FROM (SELECT run_id, q_index, tool, count(*) AS n FROM {_EVENTS} WHERE type = 'tool_call' AND tool IS NOT NULL GROUP BY ALL) GROUP BY run_id, q_index",
    "question_filter": "SELECT engine, coalesce(confident, false) AS confident, count(*) AS n, min(ask_id) AS first_id FROM ask_cache WHERE question LIKE '%report%' OR answer LIKE '%report%' GROUP BY ALL",
    "answer_hours": "SELECT strftime(make_timestamp((floor(t) * 1000000)::BIGINT), '%Y-%m-%d %H:00') AS hour, count(*) AS n, sum(coalesce(total_tokens, 0) * 3 // 4)::BIGINT AS bytes FROM chain_events GROUP BY 1",
    "encoded_answers": "SELECT ask_id, md5(to_base64(encode(answer))) AS code_md5, true AS back FROM ask_cache WHERE answer IS NOT NULL",
}
ORACLES["answers_normalized"] = f"SELECT {_normal('answer')} AS form, count(DISTINCT answer) AS n_written, count(*) AS n FROM ask_cache WHERE answer IS NOT NULL GROUP BY 1 HAVING count(DISTINCT answer) > 1"
_NUMBERS = f"list_transform(regexp_extract_all({_commas(_WIDTHS)}, '-?\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE)"
ORACLES["answer_numbers"] = f"SELECT ask_id, len({_NUMBERS}) AS n, round(coalesce(list_sum({_NUMBERS}), 0), 4) AS total FROM ask_cache WHERE answer IS NOT NULL"
