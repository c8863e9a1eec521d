"""Records in files: JSON lines, separated values, JSON documents, and stores that keep the latest row of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; a line that is no whole record, such as one still being written, is left out."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    rows = raw.select(F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.where("r._corrupt IS NULL").select(*(f"r.{f.name}" for f in schema.fields))


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record per JSON file, unreadable files left out."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def write_values(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_values(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Separated values with quoted line breaks, by a schema; an unquoted nothing is null, a quoted one is empty."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def questions(rows: DataFrame) -> DataFrame:
    """(index, question) of a table of questions, columns found by name whatever its case or else by place. An index that
    is no integer, comes twice or has no question is an error when the rows are read."""
    names = {c.strip("﻿ ").casefold(): c for c in reversed(rows.columns)}
    pick = lambda options, at: F.col(f"`{next((names[o] for o in options if o in names), rows.columns[at])}`")
    got = rows.select(F.trim(pick(("index", "id", "no"), 0).cast("string")).alias("i"), pick(("question", "problem", "text"), 1).alias("question"))
    number = got.withColumn("index", F.col("i").try_cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy("i")))
    wrong = F.when(F.col("index").isNull(), F.concat(F.lit("index is no integer: "), F.coalesce("i", F.lit("null")))).when(F.col("n") > 1, F.concat(F.lit("index comes twice: "), "i"))
    wrong = F.coalesce(wrong, F.when(~F.coalesce("question", F.lit("")).rlike(r"\S"), F.concat(F.lit("no question: "), "i")))
    return number.select(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("bigint")).otherwise(F.col("index")).alias("index"), "question")


class LatestStore:
    """Rows appended to a folder, of which the latest of each key counts."""

    def __init__(self, path: str, keys: list[str], order: list[str]):
        self.path, self.keys, self.order = path, keys, order

    def put(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def get(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.path)
        rest = [c for c in rows.columns if c not in (*self.keys, *self.order)]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.order, *rest), F.struct(*self.order)).alias("r"))
        return last.select(*self.keys, "r.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The wanted keys that aren't there yet."""
        return wanted.join(wanted.sparkSession.read.parquet(self.path).select(*self.keys), self.keys, "left_anti")
