"""Inventory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.operators import inventory as inv
from bunko.session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_files")


def _current(spark: SparkSession, d: str) -> DataFrame:
    """One row per relpath: the main mount first, then the last scan."""
    return inv.first_wins(_files(spark, d).where("relpath IS NOT NULL"), "relpath", F.col("mount"), F.desc("scanned_at"), F.desc("file_id"))


def mount_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("relpath", "file_id", "mount")


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return files.select("file_id", *(c.cast("string").alias(k) for k, c in inv.path_columns(F.col("relpath")).items()), F.substring(F.sha1(F.col("relpath").cast("binary")), 1, 12).alias("path_id"))


def manifest_delta(spark: SparkSession, d: str) -> DataFrame:
    previous = inv.first_wins(table(spark, d, "manifest").where("relpath IS NOT NULL"), "relpath", F.desc("mtime_ns"), F.desc("doc_id"))
    return inv.delta(_current(spark, d), previous)


def manifest_delta_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest_delta(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def files_by_extension(spark: SparkSession, d: str) -> DataFrame:
    top = _files(spark, d).groupBy(F.lower("ext").alias("extension")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return top.orderBy(F.desc("n"), F.col("extension").asc_nulls_last()).limit(20)


def duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    return inv.duplicates(_files(spark, d))


def project_category_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cross table in long form, with totals by project, by category and of all (rollup both ways)."""
    cube = _files(spark, d).where("project IS NOT NULL AND category IS NOT NULL").cube("project", "category")
    return cube.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = [".pdf", ".xlsx", ".pptx", ".docx"]
    out = _files(spark, d).withColumn("kind", F.lower("ext")).groupBy("category").pivot("kind", kinds).agg(F.count(F.lit(1)))
    return out.select("category", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k[1:]) for k in kinds))


def missing_extractions(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages").select("doc_id")
    return _files(spark, d).where("doc_id IS NOT NULL").join(pages, "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_files"))


def health_report(spark: SparkSession, d: str) -> DataFrame:
    return inv.health(_files(spark, d), table(spark, d, "extracted_pages"))


def catalog_flags(spark: SparkSession, d: str) -> DataFrame:
    return inv.flags(inv.page_totals(table(spark, d, "extracted_pages")))


def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    return inv.tree(_files(spark, d))


def version_groups(spark: SparkSession, d: str) -> DataFrame:
    return inv.version_groups(_files(spark, d))


def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Basenames of the manifest's paths, and the paths themselves, looked up among the files."""
    paths = table(spark, d, "manifest").where("relpath IS NOT NULL")
    asked = paths.select(F.col("relpath").alias("name")).union(paths.select(F.element_at(F.split("relpath", "/"), -1))).distinct()
    return inv.resolve(asked, _files(spark, d))


def budget_read(spark: SparkSession, d: str) -> DataFrame:
    pages = inv.first_wins(table(spark, d, "extracted_pages").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("_page", F.struct("doc_id", "no")), "_page", F.desc("extracted_at"), F.desc("page_id"))
    return inv.budget_pages(pages, 4000)


def excluded_files(spark: SparkSession, d: str) -> DataFrame:
    reasons = _files(spark, d).select(inv.excluded_reason(F.col("relpath")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (mount_first_wins, path_parts, manifest_delta, manifest_delta_counts, files_by_extension, duplicate_contents, project_category_totals, category_pivot, missing_extractions, health_report, catalog_flags, folder_tree, version_groups, path_lookup, budget_read, excluded_files)}

_CURRENT = "(SELECT * FROM corpus_files WHERE relpath IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relpath ORDER BY mount NULLS FIRST, scanned_at DESC, file_id DESC) = 1)"
_PREVIOUS = "(SELECT * FROM manifest WHERE relpath IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relpath ORDER BY mtime_ns DESC NULLS LAST, doc_id DESC NULLS LAST) = 1)"
_DELTA = f"SELECT relpath, CASE WHEN b.relpath IS NULL THEN 'added' WHEN a.relpath IS NULL THEN 'removed' WHEN a.md5 IS NOT DISTINCT FROM b.md5 THEN 'unchanged' ELSE 'changed' END AS status, coalesce(a.doc_id, b.doc_id) AS doc_id FROM {_CURRENT} a FULL JOIN {_PREVIOUS} b USING (relpath)"
_LAST = "(SELECT * FROM extracted_pages WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, no ORDER BY extracted_at DESC, page_id DESC) = 1)"
_TOTALS = f"SELECT doc_id, count(*) AS n_pages, sum(coalesce(length(text), 0)) AS n_chars, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\\S')) AS n_blank, count(*) FILTER (needs_vision) AS n_vision, sum(coalesce(len(assets), 0)) AS n_assets FROM {_LAST} GROUP BY doc_id"
_H = f"h AS (SELECT * FROM (SELECT doc_id, max(md5) AS md5, max(size) AS size FROM corpus_files WHERE doc_id IS NOT NULL GROUP BY doc_id) FULL JOIN ({_TOTALS}) USING (doc_id))"
ORACLES = {
    "mount_first_wins": f"SELECT relpath, file_id, mount FROM {_CURRENT}",
    "path_parts": "WITH p AS (SELECT file_id, relpath, string_split(relpath, '/') AS s FROM corpus_files) SELECT file_id, s[-1] AS name, lower(regexp_extract(s[-1], '(\\.[^.]+)$', 1)) AS ext, len(s)::VARCHAR AS depth, CASE WHEN len(s) >= 3 THEN s[2] END AS project, CASE WHEN len(s) >= 4 THEN s[3] WHEN len(s) = 2 THEN s[1] END AS category, substr(sha1(relpath), 1, 12) AS path_id FROM p",
    "manifest_delta": _DELTA,
    "manifest_delta_counts": f"SELECT status, count(*) AS n FROM ({_DELTA}) GROUP BY status",
    "files_by_extension": "SELECT lower(ext) AS extension, count(*) AS n, sum(size) AS bytes FROM corpus_files GROUP BY 1 ORDER BY n DESC, extension NULLS LAST LIMIT 20",
    "duplicate_contents": "SELECT md5, count(DISTINCT relpath) AS n_paths, count(*) AS n_files, min(relpath) AS first_path FROM corpus_files WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(DISTINCT relpath) > 1",
    "project_category_totals": "SELECT project, category, count(*) AS n, grouping_id(project, category) AS level FROM corpus_files WHERE project IS NOT NULL AND category IS NOT NULL GROUP BY CUBE (project, category)",
    "category_pivot": "SELECT category, count(*) FILTER (lower(ext) = '.pdf') AS pdf, count(*) FILTER (lower(ext) = '.xlsx') AS xlsx, count(*) FILTER (lower(ext) = '.pptx') AS pptx, count(*) FILTER (lower(ext) = '.docx') AS docx FROM corpus_files GROUP BY category",
    "missing_extractions": "SELECT doc_id, count(*) AS n_files FROM corpus_files f WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM extracted_pages p WHERE p.doc_id = f.doc_id) GROUP BY doc_id",
    "health_report": f"WITH {_H} SELECT 'missing' AS rule, 'fatal' AS severity, count(*) FILTER (n_pages IS NULL) AS n FROM h UNION ALL SELECT 'no_text', 'fatal', count(*) FILTER (n_chars = 0) FROM h UNION ALL SELECT 'blank_pages', 'warning', count(*) FILTER (n_blank > 0 AND n_chars > 0) FROM h UNION ALL SELECT 'needs_vision', 'todo', count(*) FILTER (n_vision > 0) FROM h UNION ALL SELECT 'unknown_file', 'warning', count(*) FILTER (n_pages IS NOT NULL AND md5 IS NULL AND size IS NULL) FROM h",
    "catalog_flags": f"SELECT *, concat_ws('|', CASE WHEN n_vision > 0 THEN 'vision:' || n_vision END, CASE WHEN n_assets > 0 THEN 'assets:' || n_assets END, CASE WHEN n_blank = n_pages THEN 'empty' END, CASE WHEN n_chars > 10000 THEN 'long' END) AS flags FROM ({_TOTALS})",
    "folder_tree": "WITH p AS (SELECT DISTINCT relpath, string_split(relpath, '/') AS s FROM corpus_files WHERE relpath IS NOT NULL), e AS (SELECT s, unnest(range(1, len(s))) AS i FROM p) SELECT array_to_string(s[1:i], '/') AS folder, i AS depth, count(*) AS n_files FROM e GROUP BY ALL",
    "path_lookup": "WITH f AS (SELECT DISTINCT relpath FROM corpus_files WHERE relpath IS NOT NULL), a AS (SELECT DISTINCT relpath AS name FROM manifest WHERE relpath IS NOT NULL UNION SELECT string_split(relpath, '/')[-1] FROM manifest WHERE relpath IS NOT NULL), t AS (SELECT relpath, string_split(relpath, '/') AS s, unnest(range(1, len(string_split(relpath, '/')) + 1)) AS i FROM f), u AS (SELECT array_to_string(s[len(s) - i + 1:], '/') AS name, min(relpath) AS only FROM t GROUP BY 1 HAVING count(*) = 1) SELECT a.name, coalesce(f.relpath, u.only) AS relpath, CASE WHEN f.relpath IS NOT NULL THEN 'exact' WHEN u.only IS NOT NULL AND a.name NOT LIKE '%/%' THEN 'name' WHEN u.only IS NOT NULL THEN 'ending' END AS how FROM a LEFT JOIN f ON f.relpath = a.name LEFT JOIN u ON u.name = a.name",
    "budget_read": "WITH p AS (SELECT * FROM extracted_pages WHERE doc_id IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, no ORDER BY extracted_at DESC, page_id DESC) = 1) SELECT doc_id, no, least(length(text), 4000) AS shown, sum(least(length(text), 4000)) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS used FROM p QUALIFY used <= 4000",
    "excluded_files": "SELECT CASE " + " ".join(f"WHEN regexp_matches(relpath, '{p}') THEN '{r}'" for r, p in inv.EXCLUDED) + " END AS reason, count(*) AS n FROM corpus_files GROUP BY 1",
}
