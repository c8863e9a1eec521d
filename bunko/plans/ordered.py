"""Queries with ordered rows: as-of and range joins, clusters, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.operators import inventory as inv
from bunko.operators import ordered as ops
from bunko.operators import runs
from bunko.functions import text as fn
from bunko.plans import documents
from bunko.session import table
from bunko.streaming import windows


def _events(spark: SparkSession, d: str) -> DataFrame:
    return runs.unique_events(table(spark, d, "chain_events"))


def ask_file_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each image question with the last scan before it of a page or file of the same content."""
    asks = table(spark, d, "ask_cache").where("md5 IS NOT NULL").select("ask_id", F.substring("md5", 1, 2).alias("key"), F.col("asked_at").alias("at"))
    scans = table(spark, d, "corpus_files").where("md5 IS NOT NULL AND scanned_at IS NOT NULL").select(F.substring("md5", 1, 2).alias("key"), F.col("scanned_at").alias("at"), "file_id")
    return ops.as_of(asks, scans, "key", "at", ["file_id"]).select("ask_id", "file_id")


def events_within_calls(spark: SparkSession, d: str) -> DataFrame:
    """Events that came while a tool was at work in the same run, in any of its questions, the call and its result too."""
    events = _events(spark, d)
    calls = runs.pairs(events).where("NOT pending").join(events.select("run_id", "q_index", F.col("seq").alias("call_seq"), F.col("t").alias("t0")), ["run_id", "q_index", "call_seq"])
    spans = calls.select("run_id", F.col("tool"), F.col("t0").alias("start"), (F.col("t0") + F.col("seconds")).alias("end"))
    points = events.select("run_id", "q_index", "seq", "t")
    found = ops.within(points, spans, "run_id", "t", "start", "end", 60.0)
    return found.groupBy("run_id", "tool").agg(F.count("*").alias("n"), F.countDistinct("q_index", "seq").alias("n_events"))


def pages_in_limits(spark: SparkSession, d: str) -> DataFrame:
    """The first range of sizes that holds each page: up to the overlap, to the limit, or to four times the limit."""
    limits = table(spark, d, "split_limits").where("filetype IN ('pdf', 'xlsx', 'docx', 'pptx', 'md', 'txt')")
    spans = limits.select(F.col("filetype").alias("kind"), F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit(0).alias("lo"), F.col("overlap_chars").alias("hi")), F.struct(F.lit(2).alias("ord"), F.lit(0).alias("lo"), F.col("max_chars").alias("hi")), F.struct(F.lit(3).alias("ord"), F.col("max_chars").alias("lo"), (F.col("max_chars") * 4).alias("hi")))).alias("s")).select("kind", "s.*")
    points = table(spark, d, "extracted_pages").where("text IS NOT NULL").select("page_id", F.ltrim(F.lower(F.trim("filetype")), F.lit(".")).alias("kind"), F.length("text").alias("n"))
    return ops.within(points, spans, "kind", "n", "lo", "hi", 1000.0, ["ord"]).select("page_id", "kind", F.col("ord").alias("size_class"))


def size_clusters(spark: SparkSession, d: str) -> DataFrame:
    """File sizes of each type, in thousands, split at their gaps."""
    files = table(spark, d, "corpus_files").where("size IS NOT NULL AND ext IS NOT NULL").select(F.lower("ext").alias("kind"), F.floor(F.col("size") / 1000).alias("kb"))
    return ops.gap_clusters(files, "kind", "kb", 3.0)


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring events of one turn within a question, merged."""
    return ops.runs(_events(spark, d), ["run_id", "q_index"], "seq", F.col("turn")).withColumnRenamed("style", "turn")


def page_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages of pages, a missing one taken from the pages around it where these agree."""
    pages = table(spark, d, "extracted_pages").where("doc_id IS NOT NULL").select("page_id", "doc_id", "no", F.lower(F.nullif(F.trim("lang"), F.lit("und"))).alias("lang"))
    return ops.inherit(pages, ["doc_id"], ["no", "page_id"], "lang").select("page_id", "lang")


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """Image questions by engine that would have met an open breaker: three failures in a row open it for ten hours."""
    asks = table(spark, d, "ask_cache").where("engine IS NOT NULL").withColumn("at", F.unix_micros(F.col("asked_at").cast("timestamp")) / 1e6)
    states = ops.breaker(asks, "engine", "at", ["at", "ask_id"], F.col("error").isNotNull() | F.col("answer").isNull(), 3, 36_000.0)
    return states.select("ask_id", "streak", "broken")


def pruned_history(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each question's events that a history within a budget keeps."""
    events = _events(spark, d).withColumn("size", F.coalesce("total_tokens", F.lit(0)))
    kept = ops.pruned_history(events, ["run_id", "q_index"], "seq", "size", 20_000, 2, 8, 600)
    return kept.groupBy("run_id", "q_index").agg(F.sum("size").alias("tokens"), F.sum("kept").alias("kept"), F.count_if(F.col("kept") < F.col("size")).alias("n_cut"))


def breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The breaker's states again, as a stream of four slices of time with the state of each engine."""
    asks = table(spark, d, "ask_cache").select(F.col("engine").alias("key"), F.col("ask_id").alias("id"), (F.unix_micros(F.col("asked_at").cast("timestamp")) / 1e6).alias("at"), (F.col("error").isNotNull() | F.col("answer").isNull()).alias("failed"))
    return windows.replayed_breaker(asks, 4, 3, 36_000.0).withColumnRenamed("id", "ask_id")


def documents_in_budget(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each project that fit 6,000 tokens together and 2,000 each, by path; those too large are skipped."""
    rows = documents.catalogue(spark, d).where("n_chars > 0").select("project", "relpath", F.floor(F.col("n_chars") / 2).alias("n_tokens"))
    return ops.within_budget(rows, ["project"], "relpath", "n_tokens", 6000, 2000)


def styled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers in the marks of a style that their row gives them."""
    asks = table(spark, d, "ask_cache").where("answer IS NOT NULL")
    style = (F.col("error").isNotNull(), F.col("latency_sec") > 30, F.col("evidence").isNull(), F.col("confident"), F.col("engine"), F.upper(F.substring("md5", 1, 6)))
    return asks.select("ask_id", fn.styled(F.col("answer"), *style).alias("styled"))


def unit_status(spark: SparkSession, d: str) -> DataFrame:
    """Files of each project and category with those still to be extracted: a file is done if its path and md5 are those
    of the manifest and its pages are there."""
    current = inv.first_wins(table(spark, d, "corpus_files").where("relpath IS NOT NULL"), "relpath", F.col("mount"), F.desc("scanned_at"), F.desc("file_id"))
    known = inv.first_wins(table(spark, d, "manifest").where("relpath IS NOT NULL"), "relpath", F.desc("mtime_ns"), F.desc("doc_id")).select("relpath", F.col("md5").alias("known_md5"), F.col("size").alias("known_size"), F.lit(1).alias("known"))
    pages = table(spark, d, "extracted_pages").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.lit(1).alias("extracted"))
    rows = current.join(known, "relpath", "left").join(pages, "doc_id", "left")
    done = F.col("known").isNotNull() & F.col("extracted").isNotNull() & F.col("size").eqNullSafe(F.col("known_size")) & F.col("md5").eqNullSafe(F.col("known_md5"))
    units = rows.groupBy("project", "category").agg(F.count("*").alias("n_files"), F.count_if(~done).alias("n_pending"))
    label = F.when(F.col("n_pending") == 0, "done").when(F.col("n_pending") == F.col("n_files"), "new").otherwise("partly")
    return units.withColumn("status", label)


def replaced_files(spark: SparkSession, d: str) -> DataFrame:
    """Names that both inventories have, each once, whose contents differ; of a name's paths the last one counts."""
    def last(name: str) -> DataFrame:
        rows = table(spark, d, name).where("relpath IS NOT NULL AND md5 IS NOT NULL").select(F.element_at(F.split("relpath", "/"), -1).alias("name"), "relpath", "md5")
        return rows.groupBy("name").agg(F.max(F.struct("relpath", "md5")).alias("x")).select("name", "x.*")

    a, b = last("corpus_files"), last("manifest").select("name", F.col("relpath").alias("old_path"), F.col("md5").alias("old_md5"))
    return a.join(b, "name").where("md5 <> old_md5").select("name", "relpath", "old_path")


def unapplied_answers(spark: SparkSession, d: str) -> DataFrame:
    """Per image the confident answers that no page of a file with that content holds."""
    answers = table(spark, d, "ask_cache").where("md5 IS NOT NULL AND confident AND answer IS NOT NULL").select("md5", "ask_id", "answer")
    pages = table(spark, d, "corpus_files").where("md5 IS NOT NULL").select("md5", "doc_id").distinct().join(table(spark, d, "extracted_pages").select("doc_id", "text"), "doc_id")
    found = answers.join(pages, "md5", "left").groupBy("md5", "ask_id").agg(F.max(F.coalesce(F.col("text").contains(F.col("answer")), F.lit(False))).alias("applied"))
    return found.groupBy("md5").agg(F.count("*").alias("n_answers"), F.count_if(~F.col("applied")).alias("n_unapplied"))


QUERIES = {f.__name__: f for f in (ask_file_as_of, events_within_calls, pages_in_limits, size_clusters, event_runs, page_languages, breaker_states, breaker_stream, pruned_history, documents_in_budget, styled_answers, unit_status, replaced_files, unapplied_answers)}

_EVENTS = "(SELECT * FROM chain_events QUALIFY row_number() OVER (PARTITION BY run_id, q_index, seq ORDER BY arrived_at) = 1)"
_CURRENT = "(SELECT * FROM corpus_files WHERE relpath IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relpath ORDER BY mount NULLS FIRST, scanned_at DESC, file_id DESC) = 1)"
_PREVIOUS = "(SELECT * FROM manifest WHERE relpath IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relpath ORDER BY mtime_ns DESC NULLS LAST, doc_id DESC NULLS LAST) = 1)"
_PAIRS = "(SELECT a.run_id, a.tool, a.t AS t0, a.t + round(b.t - a.t, 2) AS t1 FROM (SELECT *, row_number() OVER w AS nth FROM e WHERE type = 'tool_call' AND tool IS NOT NULL WINDOW w AS (PARTITION BY run_id, q_index, tool ORDER BY seq)) a JOIN (SELECT *, row_number() OVER w AS nth FROM e WHERE type = 'tool_result' AND tool IS NOT NULL WINDOW w AS (PARTITION BY run_id, q_index, tool ORDER BY seq)) b USING (run_id, q_index, tool, nth))"
ORACLES = {
    "ask_file_as_of": "SELECT ask_id, file_id FROM (SELECT ask_id, substr(md5, 1, 2) AS k, asked_at FROM ask_cache WHERE md5 IS NOT NULL) a ASOF LEFT JOIN (SELECT substr(md5, 1, 2) AS k, scanned_at, max(file_id) AS file_id FROM corpus_files WHERE md5 IS NOT NULL AND scanned_at IS NOT NULL GROUP BY ALL) f ON a.k = f.k AND a.asked_at >= f.scanned_at",
    "events_within_calls": f"WITH e AS {_EVENTS}, c AS {_PAIRS} SELECT c.run_id, c.tool, count(*) AS n, count(DISTINCT (e.q_index, e.seq)) AS n_events FROM e JOIN c ON e.run_id = c.run_id AND e.t BETWEEN c.t0 AND c.t1 GROUP BY ALL",
    "pages_in_limits": "SELECT page_id, kind, CASE WHEN n <= overlap_chars THEN 1 WHEN n <= max_chars THEN 2 ELSE 3 END::INT AS size_class FROM (SELECT page_id, ltrim(lower(trim(filetype)), '.') AS kind, length(text) AS n FROM extracted_pages WHERE text IS NOT NULL) p JOIN split_limits l ON p.kind = l.filetype WHERE kind IN ('pdf', 'xlsx', 'docx', 'pptx', 'md', 'txt') AND n <= 4 * max_chars",
    "size_clusters": "WITH v AS (SELECT lower(ext) AS kind, floor(size / 1000)::BIGINT AS kb, count(*) AS n FROM corpus_files WHERE size IS NOT NULL AND ext IS NOT NULL GROUP BY ALL), g AS (SELECT *, kb - lag(kb) OVER (PARTITION BY kind ORDER BY kb) AS gap FROM v), "
    "q AS (SELECT kind, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM g GROUP BY kind), t AS (SELECT kind, greatest(1, floor(CASE WHEN l[floor((len(l) - 1) * 0.5)::INT + 1] > 0 AND l[-1] >= 2 * l[floor((len(l) - 1) * 0.5)::INT + 1] THEN l[floor((len(l) - 1) * 0.5)::INT + 1] * 3 ELSE l[floor((len(l) - 1) * 0.1)::INT + 1] * 0.9 END)) AS tol FROM q), "
    "c AS (SELECT g.*, sum(CASE WHEN gap > tol THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY kb ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g JOIN t USING (kind)) SELECT kind, cluster, min(kb) AS first, max(kb) AS last, sum(n)::BIGINT AS n FROM c GROUP BY kind, cluster",
    "event_runs": f"SELECT run_id, q_index, turn, min(seq) AS first, max(seq) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, q_index ORDER BY seq) - row_number() OVER (PARTITION BY run_id, q_index, turn ORDER BY seq) AS g FROM {_EVENTS}) GROUP BY run_id, q_index, turn, g",
    "page_languages": "WITH p AS (SELECT page_id, doc_id, no, lower(nullif(trim(lang, ' '), 'und')) AS lang FROM extracted_pages WHERE doc_id IS NOT NULL) SELECT page_id, coalesce(lang, CASE WHEN last_value(lang IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = first_value(lang IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no, page_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) THEN last_value(lang IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) AS lang FROM p",
    "breaker_states": "WITH a AS (SELECT ask_id, engine, epoch_us(asked_at) / 1e6 AS t, error IS NOT NULL OR answer IS NULL AS f FROM ask_cache WHERE engine IS NOT NULL), i AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY engine ORDER BY t, ask_id ROWS UNBOUNDED PRECEDING) AS g FROM a), "
    "s AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY engine, g ORDER BY t, ask_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i) SELECT ask_id, streak, coalesce(t - max(CASE WHEN streak >= 3 THEN t END) OVER (PARTITION BY engine ORDER BY t, ask_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 36000, false) AS broken FROM s",
    "pruned_history": f"WITH e AS (SELECT *, coalesce(total_tokens, 0) AS size FROM {_EVENTS}), w AS (SELECT *, sum(size) OVER q AS total, count(*) OVER q AS n, row_number() OVER (PARTITION BY run_id, q_index ORDER BY seq) AS i FROM e WINDOW q AS (PARTITION BY run_id, q_index)), k AS (SELECT *, CASE WHEN total > 20000 AND n > 10 AND i > 2 AND i <= n - 8 THEN least(size, 600) ELSE size END AS kept FROM w) SELECT run_id, q_index, sum(size)::BIGINT AS tokens, sum(kept)::BIGINT AS kept, count(*) FILTER (kept < size) AS n_cut FROM k GROUP BY ALL",
    "unit_status": f"WITH r AS (SELECT c.project, c.category, m.relpath IS NOT NULL AND c.doc_id IN (SELECT doc_id FROM extracted_pages WHERE doc_id IS NOT NULL) AND c.size IS NOT DISTINCT FROM m.size AND c.md5 IS NOT DISTINCT FROM m.md5 AS done FROM {_CURRENT} c LEFT JOIN {_PREVIOUS} m USING (relpath)) SELECT project, category, count(*) AS n_files, count(*) FILTER (done IS NOT TRUE) AS n_pending, CASE WHEN count(*) FILTER (done IS NOT TRUE) = 0 THEN 'done' WHEN count(*) FILTER (done IS NOT TRUE) = count(*) THEN 'new' ELSE 'partly' END AS status FROM r GROUP BY project, category",
    "replaced_files": "WITH a AS (SELECT string_split(relpath, '/')[-1] AS name, relpath, md5 FROM corpus_files WHERE relpath IS NOT NULL AND md5 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY relpath DESC, md5 DESC) = 1), b AS (SELECT string_split(relpath, '/')[-1] AS name, relpath, md5 FROM manifest WHERE relpath IS NOT NULL AND md5 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY relpath DESC, md5 DESC) = 1) SELECT name, a.relpath, b.relpath AS old_path FROM a JOIN b USING (name) WHERE a.md5 <> b.md5",
    "unapplied_answers": "WITH p AS (SELECT DISTINCT md5, doc_id FROM corpus_files WHERE md5 IS NOT NULL), f AS (SELECT a.md5, a.ask_id, coalesce(bool_or(contains(x.text, a.answer)), false) AS applied FROM ask_cache a LEFT JOIN (SELECT md5, text FROM p JOIN extracted_pages USING (doc_id)) x USING (md5) WHERE a.md5 IS NOT NULL AND confident AND answer IS NOT NULL GROUP BY ALL) SELECT md5, count(*) AS n_answers, count(*) FILTER (NOT applied) AS n_unapplied FROM f GROUP BY md5",
}
ORACLES["breaker_stream"] = ORACLES["breaker_states"]
ORACLES["documents_in_budget"] = (
    f"WITH RECURSIVE c AS ({documents.ORACLES['catalogue']}), o AS (SELECT project, relpath, n_chars // 2 AS n, row_number() OVER (PARTITION BY project ORDER BY relpath) AS i FROM c WHERE n_chars > 0), "
    "r AS (SELECT *, n <= 2000 AS accepted, CASE WHEN n <= 2000 THEN n ELSE 0 END AS used FROM o WHERE i = 1 UNION ALL SELECT o.*, o.n <= 2000 AND r.used + o.n <= 6000, r.used + CASE WHEN o.n <= 2000 AND r.used + o.n <= 6000 THEN o.n ELSE 0 END FROM r JOIN o ON o.project IS NOT DISTINCT FROM r.project AND o.i = r.i + 1) SELECT project, relpath, n::BIGINT AS n_tokens, accepted FROM r"
)
_CORE = r"regexp_extract(answer, '(?s)^[\s\x{3000}\x{a0}]*(.*?)[\s\x{3000}\x{a0}]*$', 1)"
ORACLES["styled_answers"] = (
    f"WITH a AS (SELECT *, {_CORE} AS core FROM ask_cache WHERE answer IS NOT NULL), s AS (SELECT *, CASE WHEN error IS NOT NULL THEN '~~' || core || '~~' ELSE core END AS c1 FROM a), u AS (SELECT *, CASE WHEN latency_sec > 30 THEN '<u>' || c1 || '</u>' ELSE c1 END AS c2 FROM s), "
    "i AS (SELECT *, CASE WHEN evidence IS NULL THEN '*' || c2 || '*' ELSE c2 END AS c3 FROM u), b AS (SELECT *, CASE WHEN confident THEN '**' || c3 || '**' ELSE c3 END AS c4 FROM i), h AS (SELECT *, CASE WHEN engine <> '' THEN '==' || c4 || '=={' || engine || '}' ELSE c4 END AS c5 FROM b), "
    "c AS (SELECT *, CASE WHEN md5 <> '' THEN '[c:' || upper(substr(md5, 1, 6)) || ']' || c5 || '[/c]' ELSE c5 END AS c6 FROM h) "
    "SELECT ask_id, CASE WHEN core = '' THEN answer ELSE substr(answer, 1, instr(answer, core) - 1) || c6 || substr(answer, instr(answer, core) + length(core)) END AS styled FROM c"
)
