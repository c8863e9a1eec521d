"""Queries on documents and their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.functions import text as fn
from bunko.operators import documents as ops
from bunko.operators import inventory as inv
from bunko.session import table

RANGES = "1-2, 4,9-"
GLOBS = ["*.pdf", "*report*", "[a-m]*/*", "*/????.*", "*.[cx]*"]
TESTS = [("lessThan", 10, None), ("lessThanOrEqual", 10, None), ("greaterThan", 40, None), ("greaterThanOrEqual", 40, None), ("equal", 7, None), ("notEqual", 7, None), ("between", 5, 9), ("notBetween", 5, 9), ("containsText", "e", None), ("notContains", "e", None), ("beginsWith", "s", None), ("endsWith", "s", None)]
BUCKETS = [("pictures", r"^assets:\d+$"), ("to be read", "^vision"), ("nothing", "^empty$"), ("long", "^long$")]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The last extraction of each page."""
    pages = table(spark, d, "extracted_pages").where("doc_id IS NOT NULL")
    return inv.first_wins(pages.withColumn("_page", F.struct("doc_id", "no")), "_page", F.desc("extracted_at"), F.desc("page_id")).drop("_page")


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return inv.page_totals(table(spark, d, "extracted_pages"))


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.whole_texts(_pages(spark, d))
    return rows.select("doc_id", "n_pages", "n_chars", F.size("assets").cast("bigint").alias("n_assets"), F.md5(F.col("full_text").cast("binary")).alias("text_md5"))


def pages_in_ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages").where(ops.in_ranges(F.col("no"), RANGES)).select("page_id", "no")


def unread_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each document that reading within the budget leaves out, with what they hold."""
    pages = _pages(spark, d).where("text IS NOT NULL")
    read = inv.budget_pages(pages, 4000).select("doc_id", "no")
    marks = F.array_join(F.concat(ops.page_marks(F.col("text")), F.when(F.col("needs_vision"), F.array(F.lit("vision"))).otherwise(F.array().cast("array<string>"))), " / ")
    return pages.join(read, ["doc_id", "no"], "left_anti").select("doc_id", "no", F.length("text").alias("n_chars"), marks.alias("marks"))


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "corpus_files").where("relpath IS NOT NULL").groupBy("doc_id").agg(F.min("relpath").alias("relpath"))
    return ops.chunks(_pages(spark, d).join(paths, "doc_id", "left"))


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.table_rows(table(spark, d, "extracted_pages"), "page_id", "text", plain=False)
    return rows.select("page_id", "table_no", F.col("row_no").cast("bigint").alias("row_no"), F.size("cells").cast("bigint").alias("n_cells"), F.array_join("cells", "¦").alias("cells"))


def document_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of all documents, written as tables again, without marks."""
    rows = ops.rendered_tables(ops.table_rows(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return rows.select("doc_id", "table_no", F.length("markdown").alias("n_chars"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def document_outline(spark: SparkSession, d: str) -> DataFrame:
    return ops.outline(table(spark, d, "documents"), "doc_id", "text")


def version_chain(spark: SparkSession, d: str) -> DataFrame:
    return ops.version_chain(table(spark, d, "corpus_files"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return ops.catalogue(table(spark, d, "corpus_files"), _totals(spark, d))


def catalogue_tiles(spark: SparkSession, d: str) -> DataFrame:
    return ops.tiles(catalogue(spark, d))


def flag_buckets(spark: SparkSession, d: str) -> DataFrame:
    flags = inv.flags(_totals(spark, d)).select(F.split("flags", r"\|").alias("flags"))
    return ops.buckets(flags, "flags", BUCKETS)


def glob_counts(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "corpus_files")
    counts = files.agg(*(F.count_if(F.col("relpath").rlike(fn.glob_pattern(g))).alias(f"g{i}") for i, g in enumerate(GLOBS)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(g).alias("glob"), F.col(f"g{i}").alias("n")) for i, g in enumerate(GLOBS)))).alias("x")).select("x.*")


def predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many documents pass each test, numbers by the last digits of their size and texts by source."""
    docs = table(spark, d, "documents").select((F.col("n_chars") % 50).alias("q"), F.lower("source").alias("m"))
    counts = docs.agg(*(F.count_if(ops.compare(F.col("q") if isinstance(a, int) else F.col("m"), kind, a, b)).alias(kind) for kind, a, b in TESTS))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("test"), F.col(k).alias("n")) for k, _, _ in TESTS))).alias("x")).select("x.*")


def first_objects(spark: SparkSession, d: str) -> DataFrame:
    """The first JSON object in each document that has one."""
    found = table(spark, d, "documents").select("doc_id", ops.first_json_udf("text").alias("object"))
    return found.where("object IS NOT NULL")


def file_colours(spark: SparkSession, d: str) -> DataFrame:
    """Names of the colours that the first six digits of the files' keys stand for, as written and with red and blue
    exchanged."""
    rgb = F.substring("md5", 1, 6)
    bgr = F.concat(F.substring("md5", 5, 2), F.substring("md5", 3, 2), F.substring("md5", 1, 2))
    named = table(spark, d, "corpus_files").where("md5 IS NOT NULL").select(fn.colour_name(rgb).alias("colour"), fn.colour_name(bgr).alias("exchanged"))
    return named.groupBy("colour", "exchanged").agg(F.count("*").alias("n"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    name = fn.safe_name(F.element_at(F.split("relpath", "/"), -1))
    return table(spark, d, "corpus_files").select("file_id", name.alias("name"), F.regexp_replace("relpath", "[0-9a-f]{12}/", "DOC/").alias("masked"))


def known_types(spark: SparkSession, d: str) -> DataFrame:
    """Files by type and whether the type is one that is extracted."""
    ext = F.lower("ext")
    known = ext.isin(*(f".{k}" for k in "pdf docx xlsx pptx csv tsv txt md py json ipynb png jpg".split()))
    return table(spark, d, "corpus_files").groupBy(ext.alias("ext"), F.coalesce(known, F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each document's pages in the order of their first page, each once."""
    pages = _pages(spark, d).where("label IS NOT NULL").groupBy("doc_id", "label").agg(F.min("no").alias("no"))
    order = F.array_sort(F.collect_list(F.struct("no", "label")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["label"]), " / ").alias("labels"), F.count("*").alias("n"))


def shared_contents(spark: SparkSession, d: str) -> DataFrame:
    """Page texts that several documents have."""
    pages = table(spark, d, "extracted_pages").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return pages.groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")).where("n_docs > 1")


QUERIES = {f.__name__: f for f in (document_texts, pages_in_ranges, unread_pages, page_chunks, page_tables, document_tables, document_outline, version_chain, catalogue, catalogue_tiles, flag_buckets, glob_counts, predicate_counts, first_objects, file_colours, safe_names, known_types, distinct_labels, shared_contents)}

_LAST = "(SELECT * FROM extracted_pages WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, no ORDER BY extracted_at DESC, page_id DESC) = 1)"
_TOTALS = f"(SELECT doc_id, count(*) AS n_pages, sum(coalesce(length(text), 0)) AS n_chars, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\\S')) AS n_blank, count(*) FILTER (needs_vision) AS n_vision, sum(coalesce(len(assets), 0)) AS n_assets FROM {_LAST} GROUP BY doc_id)"
_SPLIT = r"regexp_split_to_array({0}, '\r\n|\r|\n')"


def _lines(source: str, key: str) -> str:
    return f"(SELECT {key}, unnest({_SPLIT.format('text')}) AS line, generate_subscripts({_SPLIT.format('text')}, 1) AS pos FROM {source})"


def _tables(source: str, key: str) -> str:
    return (
        f"bars AS (SELECT {key}, pos, trim(line, ' ') AS line FROM {_lines(source, key)} WHERE length(trim(line, ' ')) > 1 AND trim(line, ' ') LIKE '|%' AND trim(line, ' ') LIKE '%|'), "
        f"runs AS (SELECT *, pos - row_number() OVER (PARTITION BY {key} ORDER BY pos) AS run, regexp_matches(line, '^\\|[\\s:|-]+\\|$') AS rule FROM bars), "
        f"kept AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (rule) OVER w AS n_rules FROM runs WINDOW w AS (PARTITION BY {key}, run)) WHERE n >= 2 AND n_rules > 0 AND NOT rule), "
        f"cells AS (SELECT {key}, dense_rank() OVER (PARTITION BY {key} ORDER BY run) AS table_no, row_number() OVER (PARTITION BY {key}, run ORDER BY pos) - 1 AS row_no, list_transform(string_split(trim(line, '|'), '|'), lambda c: trim(c, ' ')) AS cells FROM kept)"
    )


_VERSION = r"""
(SELECT relpath, array_to_string(list_concat(list_filter(s[1:len(s) - 1], lambda d: lower(d) NOT IN ('old', '旧', 'archive', '_old', 'backup')), [
regexp_replace(regexp_replace(regexp_replace(regexp_extract(s[-1], '^(.*?)(\.[^.]*)?$', 1), '_pw-[^_]*', '', 'gi'),
'[_\-\s(（]*(?:v(?:er)?\.?\s*\d+(?:\.\d+)*|rev\.?\d+|final|draft|old|copy|最終版?|確定版?|修正版?|改訂版?|旧版?|コピー)[)）]*', '', 'gi'), '^[_\-\s]+|[_\-\s]+$', '', 'g') || lower(regexp_extract(s[-1], '(\.[^.]*)$', 1))]), '/') AS version_group
FROM (SELECT DISTINCT relpath, string_split(relpath, '/') AS s FROM corpus_files WHERE relpath IS NOT NULL))"""
_CHAIN = f"(SELECT relpath, version_group, row_number() OVER w AS place, count(*) OVER (PARTITION BY version_group) AS n_versions, lag(relpath) OVER w AS before, lead(relpath) OVER w AS after FROM {_VERSION} WINDOW w AS (PARTITION BY version_group ORDER BY relpath))"
_CATALOGUE = f"(SELECT relpath, doc_id, project, ext, coalesce(n_pages, 0) AS n_pages, coalesce(n_chars, 0)::BIGINT AS n_chars, coalesce(n_assets, 0)::BIGINT AS n_assets, n_versions - 1 AS n_peers FROM (SELECT relpath, min(doc_id) AS doc_id, max(project) AS project, lower(max(ext)) AS ext FROM corpus_files WHERE relpath IS NOT NULL GROUP BY relpath) LEFT JOIN {_TOTALS} USING (doc_id) JOIN {_CHAIN} USING (relpath))"
_SQL_TESTS = {"lessThan": "q < 10", "lessThanOrEqual": "q <= 10", "greaterThan": "q > 40", "greaterThanOrEqual": "q >= 40", "equal": "q = 7", "notEqual": "q <> 7", "between": "q >= 5 AND q <= 9", "notBetween": "q < 5 OR q > 9", "containsText": "m LIKE '%e%'", "notContains": "m NOT LIKE '%e%'", "beginsWith": "m LIKE 's%'", "endsWith": "m LIKE '%s'"}


def _colour(hex6: str) -> str:
    r, g, b = (f"(('0x' || substr({hex6}, {at}, 2))::INT / 255.0::DOUBLE)" for at in (1, 3, 5))
    parts = f"(SELECT r, g, b, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT {r} AS r, {g} AS g, {b} AS b))"
    hsv = f"(SELECT hi, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS sat, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN CASE WHEN g < b THEN 360 ELSE 0 END + 60 * (g - b) / (hi - lo) WHEN hi = g THEN 120 + 60 * (b - r) / (hi - lo) ELSE 240 + 60 * (r - g) / (hi - lo) END AS hue FROM {parts})"
    base = "CASE WHEN hue < 15 OR hue >= 345 THEN '赤' WHEN hue < 48 THEN CASE WHEN sat > 0.5 AND hi < 0.6 THEN '茶' ELSE 'オレンジ' END WHEN hue < 68 THEN '黄' WHEN hue < 165 THEN '緑' WHEN hue < 210 THEN '水色' WHEN hue < 255 THEN '青' WHEN hue < 290 THEN '紫' ELSE 'ピンク' END"
    return f"(SELECT CASE WHEN sat < 0.06 THEN CASE WHEN hi > 0.92 THEN '' WHEN hi < 0.25 THEN '黒' ELSE 'グレー' END WHEN hi < 0.35 THEN '濃' || {base} WHEN sat < 0.3 AND hi > 0.85 THEN '薄' || {base} ELSE {base} END FROM {hsv})"


ORACLES = {
    "document_texts": f"SELECT doc_id, count(*) AS n_pages, sum(coalesce(length(text), 0))::BIGINT AS n_chars, sum(coalesce(len(assets), 0))::BIGINT AS n_assets, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY no) FILTER (regexp_matches(text, '\\S')), '')) AS text_md5 FROM {_LAST} GROUP BY doc_id",
    "pages_in_ranges": "SELECT page_id, no FROM extracted_pages WHERE no IN (1, 2, 4) OR no >= 9",
    "unread_pages": f"WITH p AS (SELECT *, sum(least(length(text), 4000)) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS used FROM {_LAST} WHERE text IS NOT NULL) SELECT doc_id, no, length(text)::INT AS n_chars, concat_ws(' / ', " + ", ".join(f"CASE WHEN contains(text, '{k}') THEN '{v}' END" for k, v in ops.PAGE_MARKS) + ", CASE WHEN needs_vision THEN 'vision' END) AS marks FROM p WHERE used > 4000",
    "page_tables": "WITH " + _tables("extracted_pages", "page_id") + " SELECT page_id, table_no::INT AS table_no, row_no, len(cells) AS n_cells, array_to_string(cells, '¦') AS cells FROM cells",
    "document_outline": f"SELECT doc_id, pos::INT AS line_no, length(regexp_extract(line, '^(#+)', 1))::INT AS level, trim(regexp_extract(line, '(?s)^#+\\s+(.*)$', 1), ' ') AS title FROM {_lines('documents', 'doc_id')} WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S')",
    "version_chain": f"SELECT relpath, version_group, place::INT AS place, n_versions, before, after FROM {_CHAIN}",
    "catalogue": f"SELECT * FROM {_CATALOGUE}",
    "catalogue_tiles": f"SELECT count(DISTINCT project) AS n_projects, count(*) AS n_files, count(DISTINCT ext) AS n_types, sum(n_assets)::BIGINT AS n_assets, count(*) FILTER (n_peers > 0) AS n_with_peers FROM {_CATALOGUE}",
    "flag_buckets": f"WITH t AS (SELECT * FROM {_TOTALS}) SELECT 'pictures' AS bucket, count(*) FILTER (n_assets > 0) AS n FROM t UNION ALL SELECT 'to be read', count(*) FILTER (n_vision > 0) FROM t UNION ALL SELECT 'nothing', count(*) FILTER (n_blank = n_pages) FROM t UNION ALL SELECT 'long', count(*) FILTER (n_chars > 10000) FROM t",
    "glob_counts": " UNION ALL ".join(f"SELECT '{g}' AS glob, count(*) FILTER (relpath GLOB '{g}') AS n FROM corpus_files" for g in GLOBS),
    "predicate_counts": " UNION ALL ".join(f"SELECT '{k}' AS test, count(*) FILTER ({t}) AS n FROM (SELECT n_chars % 50 AS q, lower(source) AS m FROM documents)" for k, t in _SQL_TESTS.items()),
    "file_colours": f"SELECT {_colour('md5')} AS colour, {_colour('(substr(md5, 5, 2) || substr(md5, 3, 2) || substr(md5, 1, 2))')} AS exchanged, count(*) AS n FROM corpus_files WHERE md5 IS NOT NULL GROUP BY ALL",
    "safe_names": "SELECT file_id, substr(coalesce(nullif(rtrim(regexp_replace(trim(nfc_normalize(string_split(relpath, '/')[-1]), ' '), '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '. '), ''), 'item'), 1, 120) AS name, regexp_replace(relpath, '[0-9a-f]{12}/', 'DOC/', 'g') AS masked FROM corpus_files",
    "known_types": "SELECT lower(ext) AS ext, coalesce(ltrim(lower(ext), '.') IN ('pdf', 'docx', 'xlsx', 'pptx', 'csv', 'tsv', 'txt', 'md', 'py', 'json', 'ipynb', 'png', 'jpg'), false) AS known, count(*) AS n FROM corpus_files GROUP BY ALL",
    "distinct_labels": f"SELECT doc_id, string_agg(label, ' / ' ORDER BY no, label) AS labels, count(*) AS n FROM (SELECT doc_id, label, min(no) AS no FROM {_LAST} WHERE label IS NOT NULL GROUP BY ALL) GROUP BY doc_id",
    "shared_contents": "SELECT md5(text) AS text_md5, count(DISTINCT doc_id) AS n_docs, count(*) AS n_pages, min(page_id) AS first_page FROM extracted_pages WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
}
ORACLES["version_groups"] = f"SELECT version_group, count(*) AS n_versions, min(relpath) AS first_path, max(relpath) AS last_path FROM {_VERSION} GROUP BY version_group HAVING count(*) > 1"
