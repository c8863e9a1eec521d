"""Documents from their pages: whole texts, chunks, tables, outlines, page ranges, version chains, catalogue."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bunko.functions.text import markdown_table, strip_markup, version_key

LINE_BREAK = r"\r\n|\r|\n"
# Text that marks what a page holds besides its words, and the name of the mark.
PAGE_MARKS = [("埋め込みEMFオブジェクト", "EMF埋め込み表あり"), ("### 埋め込みグラフ", "埋め込みグラフあり"), ("[画像読み取り]", "画像の読み取り結果あり"), ("## コメント", "コメントあり"), ("[ページ情報]", "ページ情報あり"), ("### ピボットテーブル定義", "ピボット定義あり"), ("[画像:", "画像あり")]


def whole_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_chars, assets, full_text): pages (doc_id, no, text, assets) in order, one row per page; pages
    without visible text are left out of the text. A document's pages are collected, as its text is one value."""
    each = F.array_sort(F.collect_list(F.struct("no", "text", "assets")))
    rows = pages.groupBy("doc_id").agg(each.alias("p"))
    shown = F.filter(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), lambda t: t.rlike(r"\S"))
    size = F.aggregate("p", F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.length(x["text"]), F.lit(0)))
    assets = F.flatten(F.transform("p", lambda x: F.coalesce(x["assets"], F.array().cast("array<string>"))))
    return rows.select("doc_id", F.size("p").cast("bigint").alias("n_pages"), size.alias("n_chars"), assets.alias("assets"), F.array_join(shown, "\n\n").alias("full_text"))


def page_marks(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.contains(key), label) for key, label in PAGE_MARKS)))


def in_ranges(no: Column, ranges: str | None) -> Column:
    """Is a page in ranges such as '1-5,8,10-'? None, and ranges that say nothing, take every page."""
    tests = []
    for part in (ranges or "").split(","):
        lo, dash, hi = (x.strip() for x in part.partition("-"))
        if dash:
            tests.append(no.between(int(lo) if lo.isdigit() else 1, int(hi) if hi.isdigit() else 2**31 - 1))
        elif lo.isdigit():
            tests.append(no == int(lo))
    out = F.lit(not tests)
    for t in tests:
        out = out | t
    return out


def compare(value: Column, kind: str, first, second=None) -> Column:
    """The tests of conditional formats, by name."""
    tests = {
        "lessThan": lambda: value < first, "lessThanOrEqual": lambda: value <= first, "greaterThan": lambda: value > first, "greaterThanOrEqual": lambda: value >= first,
        "equal": lambda: value == first, "notEqual": lambda: value != first, "between": lambda: value.between(first, second), "notBetween": lambda: ~value.between(first, second),
        "containsText": lambda: value.contains(first), "notContains": lambda: ~value.contains(first), "beginsWith": lambda: value.startswith(first), "endsWith": lambda: value.endswith(first),
    }
    return tests[kind]()


def pack(text: str, target: int, overlap: bool) -> list[str]:
    """Chunks of about `target` tokens (half the characters): paragraphs are gathered until the next would pass it; one
    far above it goes line by line, and then two lines are repeated if an overlap is wanted."""
    size = lambda t: len(t) // 2
    if size(text) * 10 <= target * 13:
        return [text]
    units: list[tuple[str, bool]] = []
    for paragraph in text.split("\n\n"):
        giant = size(paragraph) * 2 > target * 3
        units += [(line, True) for line in paragraph.split("\n")] if giant else [(paragraph, False)]
    out: list[str] = []
    held: list[str] = []
    for unit, is_line in units:
        if held and sum(map(size, held)) + size(unit) > target:
            out.append(("\n" if is_line else "\n\n").join(held))
            held = held[-2:] if is_line and overlap else []
        held.append(unit)
    return [c for c in [*out, "\n\n".join(held)] if c.strip()]


def chunks(pages: DataFrame, target: int = 600, overlap: bool = True) -> DataFrame:
    """(chunk_id, doc_id, no, chunk_no, text) of pages (doc_id, no, label, relpath, text) with visible text; each chunk
    says where it is from."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: pack(t, target, overlap))

    head = F.concat(F.lit("["), F.coalesce("relpath", F.lit("")), F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" / "), "label")).otherwise(""), F.lit(" p"), F.col("no"), F.lit("]\n"))
    rows = pages.where(F.col("text").rlike(r"\S")).select("doc_id", "no", head.alias("head"), F.posexplode(packed("text")).alias("chunk_no", "piece"))
    return rows.select(F.concat_ws(":", "doc_id", "no", "chunk_no").alias("chunk_id"), "doc_id", "no", "chunk_no", F.concat("head", "piece").alias("text"))


def table_rows(pages: DataFrame, key: str, text: str, plain: bool = True) -> DataFrame:
    """(key, table_no, row_no, cells) of the tables in a text: at least two lines in a row that begin and end with a bar,
    one of them a rule; row 0 is the header. `plain` takes marks off the cells. Only lines of tables travel."""
    lines = pages.select(key, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("at", "line")).select(key, "at", F.trim("line").alias("line"))
    bars = lines.where((F.length("line") > 1) & F.col("line").startswith("|") & F.col("line").endswith("|"))
    order = Window.partitionBy(key).orderBy("at")
    run = bars.withColumn("run", F.col("at") - F.row_number().over(order)).withColumn("rule", F.col("line").rlike(r"^\|[\s:|-]+\|$"))
    whole = Window.partitionBy(key, "run")
    kept = run.withColumn("n", F.count("*").over(whole)).withColumn("n_rules", F.count_if("rule").over(whole)).where("n >= 2 AND n_rules > 0 AND NOT rule")
    numbered = kept.withColumn("table_no", F.dense_rank().over(Window.partitionBy(key).orderBy("run"))).withColumn("row_no", F.row_number().over(Window.partitionBy(key, "run").orderBy("at")) - 1)
    bare = F.regexp_replace("line", r"^\|+|\|+$", "")
    cells = F.transform(F.split(bare, r"\|"), lambda c: F.trim(strip_markup(F.trim(c))) if plain else F.trim(c))
    return numbered.select(key, "table_no", "row_no", cells.alias("cells"))


def rendered_tables(rows: DataFrame, key: str) -> DataFrame:
    """(key, table_no, markdown) of rows (key, table_no, row_no, cells)."""
    whole = rows.groupBy(key, "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    return whole.select(key, "table_no", markdown_table(F.transform("r", lambda x: x["cells"])).alias("markdown"))


def outline(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, level, title): headings of a text."""
    lines = pages.select(key, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("at", "line")).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    return lines.select(key, (F.col("at") + 1).alias("line_no"), F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"(?s)^#+\s+(.*)$", 1)).alias("title"))


def version_chain(files: DataFrame) -> DataFrame:
    """(relpath, version_group, place, n_versions, before, after): each path among the versions of its file, in the order
    of paths. Its peers are the rows of its group; they aren't written beside each, as a group has no bound."""
    keyed = files.where("relpath IS NOT NULL").select("relpath", version_key(F.col("relpath")).alias("version_group")).distinct()
    order = Window.partitionBy("version_group").orderBy("relpath")
    place, size = F.row_number().over(order), F.count("*").over(Window.partitionBy("version_group"))
    return keyed.select("relpath", "version_group", place.alias("place"), size.alias("n_versions"), F.lag("relpath").over(order).alias("before"), F.lead("relpath").over(order).alias("after"))


def catalogue(files: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per path: its document's pages, characters and assets, and the number of other versions of the file."""
    peers = version_chain(files).select("relpath", (F.col("n_versions") - 1).alias("n_peers"))
    one = files.where("relpath IS NOT NULL").groupBy("relpath").agg(F.min("doc_id").alias("doc_id"), F.max("project").alias("project"), F.lower(F.max("ext")).alias("ext"))
    rows = one.join(totals.select("doc_id", "n_pages", "n_chars", "n_assets"), "doc_id", "left").join(peers, "relpath")
    return rows.select("relpath", "doc_id", "project", "ext", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pages", "n_chars", "n_assets", "n_peers")))


def tiles(rows: DataFrame) -> DataFrame:
    """The catalogue in five numbers."""
    return rows.agg(F.countDistinct("project").alias("n_projects"), F.count("*").alias("n_files"), F.countDistinct("ext").alias("n_types"), F.sum("n_assets").alias("n_assets"), F.count_if(F.col("n_peers") > 0).alias("n_with_peers"))


def buckets(rows: DataFrame, flags: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(bucket, n): rows whose array of flags has one that matches the bucket's pattern; empty buckets too."""
    one = lambda p: F.count_if(F.exists(flags, lambda x: x.rlike(p)))
    held = rows.agg(*(one(p).alias(name) for name, p in patterns))
    return held.select(F.explode(F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"`{name}`").alias("n")) for name, _ in patterns))).alias("x")).select("x.*")


_JSON_SIGN = re.compile(r'\\.|["{}]', re.S)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def first_json(text: str) -> str | None:
    """The first balanced JSON object in a text, braces in strings aside; what is balanced but no JSON is passed over."""
    start = text.find("{")
    while start >= 0:
        depth, quoted = 0, False
        for m in _JSON_SIGN.finditer(text, start):
            c = m.group()
            if c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    if _is_json(found := text[start : m.end()]):
                        return found
                    break
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def first_json_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: first_json(t) if "{" in t else None, na_action="ignore")
