"""Files as rows: listing with exclusions, text by a ladder of encodings, previews of separated values."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bunko.operators.inventory import excluded_reason

# Encodings in the order in which they are tried, the most characters of a text, and of previews the most
# rows shown whole, the rows shown of longer ones and the columns named.
ENCODINGS = ("utf-8-sig", "utf-8", "cp932", "euc-jp", "latin-1")
MOST_CHARS, WHOLE_ROWS, PREVIEW_ROWS, NAMED_COLUMNS = 400_000, 200, 25, 60
FENCES = {"py": "python", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "sh": "bash"}
OLE = bytes.fromhex("D0CF11E0A1B11AE1")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, reason) of all files below a folder; reason says why a file is left out of the corpus, null
    if it isn't. Contents aren't read. Spark itself never lists names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.withColumn("reason", excluded_reason(F.col("path")))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, md5, encrypted) of the files that stay; encrypted office files are told by their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(excluded_reason(F.col("path")).isNull())
    return files.select("path", "content", F.md5("content").alias("md5"), (F.substring("content", 1, 8) == F.lit(OLE)).alias("encrypted"))


_STRINGS = T.ArrayType(T.StringType())


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    def one(raw: bytes | None) -> tuple[str | None, str | None]:
        for name in ENCODINGS if raw is not None else ():
            try:
                return bytes(raw).decode(name), name
            except UnicodeDecodeError:
                continue
        return None, None

    return pd.DataFrame([one(c) for c in content], columns=["text", "encoding"])


def plain_page(text: Column, ext: Column) -> Column:
    """(text, n_chars, n_lines, truncated): a text as a page, cut at MOST_CHARS, code in a fence of its language."""
    cut = F.when(F.length(text) > MOST_CHARS, F.concat(F.substring(text, 1, MOST_CHARS), F.lit("\n... [the rest is left out]"))).otherwise(text)
    kind = F.ltrim(F.lower(ext), F.lit("."))
    fence = F.coalesce(*(F.when(kind == k, v) for k, v in FENCES.items()))
    body = F.when(fence.isNotNull(), F.concat(F.lit("```"), fence, F.lit("\n"), cut, F.lit("\n```"))).otherwise(cut)
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.struct(body.alias("text"), F.length(text).alias("n_chars"), n_lines.alias("n_lines"), (F.length(text) > MOST_CHARS).alias("truncated"))


def tabular_preview(separator: str):
    """A function of text columns: (n_rows, columns, rows, truncated) of separated values, blank rows aside; up to WHOLE_ROWS
    rows are all shown, of more only PREVIEW_ROWS below the header."""

    @F.pandas_udf(T.StructType([T.StructField("n_rows", T.IntegerType()), T.StructField("columns", _STRINGS), T.StructField("rows", T.ArrayType(_STRINGS)), T.StructField("truncated", T.BooleanType())]))
    def preview(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            rows = [r for r in csv.reader(io.StringIO(t or ""), delimiter=separator) if any(c.strip() for c in r)]
            whole = len(rows) <= WHOLE_ROWS
            out.append((max(len(rows) - 1, 0), rows[0][:NAMED_COLUMNS] if rows else [], rows if whole else rows[: PREVIEW_ROWS + 1], not whole))
        return pd.DataFrame(out, columns=["n_rows", "columns", "rows", "truncated"])

    return preview
