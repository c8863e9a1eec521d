"""Answers to questions: comparison, defaults for missing ones, validation, evidence excerpts, batch statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunko.functions.text import normalize_answer, same_answer, same_elements, token_estimate


def successive(asks: DataFrame) -> DataFrame:
    """Each answer of an image's question with the one before it: the same in substance, as an enumeration, or at all?"""
    order = Window.partitionBy("md5", "question").orderBy("asked_at", "ask_id")
    rows = asks.where("md5 IS NOT NULL").select("ask_id", F.lag("ask_id").over(order).alias("before_id"), "answer", F.lag("answer").over(order).alias("before")).where("before_id IS NOT NULL")
    same, listed = same_answer(F.col("answer"), F.col("before")), same_elements(F.col("answer"), F.col("before"))
    return rows.select("ask_id", "before_id", "answer", "before", same.alias("same"), listed.alias("same_elements")).withColumn("agree", F.col("same") | F.col("same_elements"))


def with_default(questions: DataFrame, answers: DataFrame, keys: list[str], default: str) -> DataFrame:
    """Every question with its answer, or the default for a missing or blank one."""
    blank = ~F.coalesce("answer", F.lit("")).rlike(r"\S")
    return questions.join(answers, keys, "left").withColumn("missing", blank).withColumn("answer", F.when(blank, F.lit(default)).otherwise(F.col("answer")))


def violations(answers: DataFrame, expected: DataFrame, key: str, max_tokens: int) -> DataFrame:
    """(rule, key, n) of a table of answers (key as text, answer): each rule with the keys that break it."""
    number = F.trim(key).rlike(r"^-?\d+$")
    rows = answers.withColumn("_key", F.trim(key))
    text = F.coalesce("answer", F.lit(""))
    tests: list[tuple[str, Column]] = [
        ("key is no integer", ~F.coalesce(number, F.lit(False))), ("blank", number & ~text.rlike(r"\S")), ("line break", number & text.rlike(r"[\r\n]")), ("tab", number & text.contains("\t")),
        ("too long", number & (token_estimate(F.col("answer")) > max_tokens)),
    ]
    found = [rows.where(test).groupBy("_key").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.col("_key").alias("key"), "n") for rule, test in tests]
    seen = rows.where(number).groupBy("_key").agg(F.count("*").alias("n"))
    found.append(seen.where("n > 1").select(F.lit("repeated").alias("rule"), F.col("_key").alias("key"), "n"))
    wanted = expected.select(F.col(key).cast("string").alias("_key")).distinct()
    found.append(wanted.join(seen, "_key", "left_anti").select(F.lit("missing").alias("rule"), F.col("_key").alias("key"), F.lit(1).cast("bigint").alias("n")))
    found.append(seen.join(wanted, "_key", "left_anti").select(F.lit("extra").alias("rule"), F.col("_key").alias("key"), "n"))
    return reduce(DataFrame.unionByName, found)


def excerpts(asks: DataFrame, each: int, most: int) -> DataFrame:
    """(md5, n_evidence, excerpt): the first evidences of each image, each cut, in the order asked. Only the first `most`
    of an image are gathered, whatever their number."""
    order = Window.partitionBy("md5").orderBy("asked_at", "ask_id")
    rows = asks.where("md5 IS NOT NULL").where(F.col("evidence").rlike(r"\S")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("_n", F.substring("evidence", 1, each).alias("e"))))
    return rows.groupBy("md5").agg(F.count("*").alias("n_evidence"), F.array_join(F.transform(parts, lambda x: x["e"]), "\n").alias("excerpt"))


def batch_statistics(asks: DataFrame, n_errors: int) -> DataFrame:
    """(engine, done, failed, empty, first_errors): how a batch went, with its first errors."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("answer", F.lit("")).rlike(r"\S"), "done").otherwise("empty")
    rows = asks.withColumn("status", status)
    totals = rows.groupBy("engine").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "empty")))
    order = Window.partitionBy("engine").orderBy("asked_at", "ask_id")
    some = rows.where("status = 'failed'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n_errors)
    first = some.groupBy("engine").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "error"))), lambda x: x["error"]), " / ").alias("first_errors"))
    first = first.withColumnRenamed("engine", "_engine")
    return totals.join(first, F.col("engine").eqNullSafe(F.col("_engine")), "left").select("engine", "done", "failed", "empty", F.coalesce("first_errors", F.lit("")).alias("first_errors"))


def engines_by_type(asks: DataFrame, files: DataFrame, first: int) -> DataFrame:
    """(ext, engine, n, n_ok, mean_sec, sample): engines by the type of the image's file, with the first questions."""
    kinds = files.where("md5 IS NOT NULL").groupBy("md5").agg(F.min(F.lower("ext")).alias("ext"))
    rows = asks.join(kinds, "md5", "left").withColumn("ext", F.coalesce("ext", F.lit("?")))
    order = Window.partitionBy("ext", "engine").orderBy("ask_id")
    some = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first).groupBy("ext", "engine").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ask_id")), lambda x: x.cast("string")), ",").alias("sample"))
    ok = F.col("error").isNull() & F.coalesce("answer", F.lit("")).rlike(r"\S")
    totals = rows.groupBy("ext", "engine").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg("latency_sec"), 4).alias("mean_sec"))
    some = some.select(F.col("ext").alias("_x"), F.col("engine").alias("_e"), "sample")
    return totals.join(some, (F.col("ext") == F.col("_x")) & F.col("engine").eqNullSafe(F.col("_e")), "left").drop("_x", "_e")


def merged_usage(rows: DataFrame, keys: list[str], usage: str) -> DataFrame:
    """Maps of numbers added up by key; entries without a number are left out."""
    each = rows.select(*keys, F.explode(usage).alias("measure", "amount")).where("amount IS NOT NULL")
    return each.groupBy(*keys, "measure").agg(F.round(F.sum("amount"), 3).alias("amount"))


def distinct_forms(asks: DataFrame) -> DataFrame:
    """(form, n): answers in normal form and how often each occurs."""
    return asks.where("answer IS NOT NULL").groupBy(normalize_answer(F.col("answer")).alias("form")).agg(F.count("*").alias("n"))
