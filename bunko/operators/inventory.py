"""Corpus inventory: derived path columns, change sets, duplicates, versions, catalogue, health and tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunko.functions.text import version_key

EXCLUDED = [("office lock file", r"(^|/)~\$[^/]*$"), ("lock file", r"(^|/)\.~lock\.[^/]*$"), ("compiled file", r"\.py[co]$"), ("system file", r"(^|/)(\.DS_Store|Thumbs\.db|desktop\.ini)$"), ("pruned folder", r"(^|/)(__pycache__|\.git|\.ipynb_checkpoints|\.venv|venv|node_modules)/")]


def path_columns(path: Column) -> dict[str, Column]:
    """name, ext (lower case), depth, and project and category by depth: from four parts on the second and third, of
    three the second, of two only a category."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return {
        "name": F.element_at(parts, -1), "ext": F.lower(F.regexp_extract(F.element_at(parts, -1), r"(\.[^.]+)$", 1)), "depth": n,
        "project": F.when(n >= 3, F.get(parts, F.lit(1))), "category": F.when(n >= 4, F.get(parts, F.lit(2))).when(n == 2, F.get(parts, F.lit(0))),
    }


def excluded_reason(path: Column) -> Column:
    """First pattern that excludes a path, null for paths that stay."""
    return F.coalesce(*(F.when(path.rlike(p), reason) for reason, p in EXCLUDED))


def first_wins(files: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row per key; a hot key is cut down in each task first (the limit is pushed below the exchange)."""
    return files.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(relpath, status, doc_id) of two inventories with one row per relpath; a rename is a removal and an addition."""
    a, b = current.select("relpath", F.col("md5").alias("md5_a"), F.col("doc_id").alias("doc_a"), F.lit(1).alias("in_a")), previous.select("relpath", F.col("md5").alias("md5_b"), F.col("doc_id").alias("doc_b"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(F.col("md5_a").eqNullSafe(F.col("md5_b")), "unchanged").otherwise("changed")
    return a.join(b, "relpath", "full").select("relpath", status.alias("status"), F.coalesce("doc_a", "doc_b").alias("doc_id"))


def duplicates(files: DataFrame) -> DataFrame:
    """Contents that more than one path has."""
    return files.where("md5 IS NOT NULL").groupBy("md5").agg(F.countDistinct("relpath").alias("n_paths"), F.count("*").alias("n_files"), F.min("relpath").alias("first_path")).where("n_paths > 1")


def version_groups(files: DataFrame) -> DataFrame:
    """(version_group, n_versions, first, last) of the groups of paths that are versions of one file; a group's paths
    are counted, not collected, as a short name may occur any number of times."""
    keyed = files.where("relpath IS NOT NULL").select("relpath", version_key(F.col("relpath")).alias("version_group"))
    return keyed.groupBy("version_group").agg(F.countDistinct("relpath").alias("n_versions"), F.min("relpath").alias("first_path"), F.max("relpath").alias("last_path")).where("n_versions > 1")


def page_totals(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_chars, n_blank, n_vision, n_assets) over the last extraction of each page."""
    last = first_wins(pages.where("doc_id IS NOT NULL").withColumn("_page", F.struct("doc_id", "no")), "_page", F.desc("extracted_at"), F.desc("page_id"))
    return last.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"), F.count_if(~F.coalesce("text", F.lit("")).rlike(r"\S")).alias("n_blank"),
        F.count_if("needs_vision").alias("n_vision"), F.sum(F.coalesce(F.size("assets"), F.lit(0))).cast("bigint").alias("n_assets"),
    )


def health(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(rule, severity, n): what is wrong with the extraction; a rule without finding has 0."""
    docs = files.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("md5").alias("md5"), F.max("size").alias("size"))
    totals = page_totals(pages)
    both = docs.join(totals, "doc_id", "full").agg(
        F.count_if(F.col("n_pages").isNull()).alias("missing"), F.count_if(F.col("n_pages").isNotNull() & F.col("n_chars").isNotNull() & (F.col("n_chars") == 0)).alias("no_text"),
        F.count_if((F.col("n_blank") > 0) & (F.col("n_chars") > 0)).alias("blank_pages"), F.count_if(F.col("n_vision") > 0).alias("needs_vision"),
        F.count_if(F.col("n_pages").isNotNull() & F.col("md5").isNull() & F.col("size").isNull()).alias("unknown_file"),
    )
    rules = [("missing", "fatal"), ("no_text", "fatal"), ("blank_pages", "warning"), ("needs_vision", "todo"), ("unknown_file", "warning")]
    return both.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col(r).alias("n")) for r, s in rules))).alias("x")).select("x.*")


def flags(totals: DataFrame) -> DataFrame:
    """Catalogue flags of each document, in a fixed order."""
    marks = F.array_compact(F.array(F.when(F.col("n_vision") > 0, F.concat(F.lit("vision:"), F.col("n_vision"))), F.when(F.col("n_assets") > 0, F.concat(F.lit("assets:"), F.col("n_assets"))), F.when(F.col("n_blank") == F.col("n_pages"), F.lit("empty")), F.when(F.col("n_chars") > 10_000, F.lit("long"))))
    return totals.withColumn("flags", F.array_join(marks, "|"))


def tree(files: DataFrame) -> DataFrame:
    """(folder, depth, n_files): every folder with the number of files anywhere below it."""
    parts = F.split("relpath", "/")
    up = files.where("relpath IS NOT NULL").select("relpath").distinct().where(F.size(parts) > 1)
    folders = up.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    return folders.groupBy("folder").agg(F.count("*").alias("n_files")).select("folder", F.size(F.split("folder", "/")).cast("bigint").alias("depth"), "n_files")


def resolve(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(name, relpath, how): each asked path found exactly, by a basename that is unique, or by a unique ending; else
    null. The candidates are grouped to a unique one before they are joined."""
    paths = files.where("relpath IS NOT NULL").select("relpath").distinct()
    parts = F.split("relpath", "/")
    tails = paths.select("relpath", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "/"))).alias("name"))
    unique = tails.join(asked.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"), F.min("relpath").alias("only")).where("n = 1").select("name", "only")
    exact = paths.select(F.col("relpath").alias("name"), F.col("relpath").alias("same"))
    found = asked.join(exact, "name", "left").join(unique, "name", "left")
    how = F.when(F.col("same").isNotNull(), "exact").when(F.col("only").isNotNull() & ~F.col("name").contains("/"), "name").when(F.col("only").isNotNull(), "ending")
    return found.select("name", F.coalesce("same", "only").alias("relpath"), how.alias("how"))


def budget_pages(pages: DataFrame, budget: int) -> DataFrame:
    """Pages of each document read from the first until the budget of characters is used up; the first always comes,
    cut to the budget, and reading stops at the first page that doesn't fit."""
    order = Window.partitionBy("doc_id").orderBy("no")
    size = F.least(F.length("text"), F.lit(budget))
    seen = pages.withColumn("used", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where(F.col("used") <= budget).withColumn("shown", size).select("doc_id", "no", "shown", "used")
