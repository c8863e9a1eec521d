"""Problem 1: cut texts above a size limit into overlapping pieces at natural boundaries.

A text is first cut into atomic segments: at paragraph ends, line and table-row ends and sentence ends; a segment that
doesn't fit is cut at clause marks, then at blanks, then between grapheme clusters, then anywhere. All pairs of
neighbours wait in a heap, and the weakest boundary is dissolved first (of equal ones the pair with the smaller sum)
as long as the two together plus the overlap fit the limit. Each piece but the first then begins with exactly the last
`overlap` characters of the piece before it, so that no piece is longer than the limit and, without the overlaps, the
pieces are the text. A heading clings to what follows it.

Texts within the limit, empty ones and nulls have no pieces. A missing or unlisted file type has the row `default`;
letter case, outer blanks and a leading dot don't matter. Every row counts for itself, so pages extracted again have
pieces of their own, told apart by page_id. An overlap that leaves no room (>= the limit) is cut to the limit less one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.session import table

ANYWHERE, CLUSTER, BLANK, CLAUSE, HEADING, SENTENCE, LINE, PARAGRAPH = range(8)
_BREAK = r"(?:\r\n|[\n\r  \u0085])"
_ENDS = re.compile(
    rf"(?P<paragraph>{_BREAK}[ \t　]*{_BREAK}\s*|\f\s*)|(?P<line>{_BREAK})|(?P<sentence>[。！？!?．]+[」』）)\]”’\"']*[ 　]*|\.[)\]”’\"']*[ \t]+)"
)
_CLAUSES = re.compile(r"[、，,;；:：|｜\t]+ *")
_BLANKS = re.compile(r"\s+")


def _spans(text: str, start: int, end: int, found: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, strength of the boundary behind it) from (place, strength) in ascending order."""
    at = start
    for place, strength in found:
        if at < place < end:
            yield at, place, strength
            at = place
    yield at, end, PARAGRAPH


def _natural(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    line = start
    for m in _ENDS.finditer(text, start, end):
        kind = m.lastgroup
        if kind == "sentence":
            yield m.end(), SENTENCE
            continue
        heading = text.startswith("#", line)
        line = m.end()
        yield line, HEADING if heading else PARAGRAPH if kind == "paragraph" else LINE


def _clusters(text: str, start: int, end: int, room: int) -> Iterator[tuple[int, int]]:
    import regex

    at = start
    for m in regex.finditer(r"\X", text[start:end]):
        lo, hi = start + m.start(), start + m.end()
        while hi - at > room:
            if lo > at:
                at = lo
                yield at, CLUSTER
            else:
                at += room
                yield at, ANYWHERE


def atoms(text: str, room: int) -> list[tuple[int, int, int]]:
    """Segments of at most `room` characters with the strength of the boundary behind each."""
    cuts = (
        _natural,
        lambda t, s, e: ((m.end(), CLAUSE) for m in _CLAUSES.finditer(t, s, e)),
        lambda t, s, e: ((m.end(), BLANK) for m in _BLANKS.finditer(t, s, e)),
        lambda t, s, e: _clusters(t, s, e, room),
    )
    done: list[tuple[int, int, int]] = []
    todo = [(0, len(text), PARAGRAPH, 0)]
    while todo:
        start, end, strength, level = todo.pop()
        if level == len(cuts) or level and end - start <= room:
            done.append((start, end, strength))
            continue
        inner = list(_spans(text, start, end, cuts[level](text, start, end)))
        inner[-1] = (*inner[-1][:2], strength)
        todo += [(*x, level + 1) for x in reversed(inner)]
    return done


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start with the overlap, start of what is new, end) of each piece."""
    limit = max(limit, 1)
    overlap = min(max(overlap, 0), limit - 1)
    room = limit - overlap
    if len(text) <= limit:
        return [(0, 0, len(text))]
    parts = atoms(text, room)
    end = [e for _, e, _ in parts]
    start = [s for s, _, _ in parts]
    nxt, prev = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    alive = [True] * len(parts)
    heap = [(parts[i][2], end[i + 1] - start[i], i, i + 1) for i in range(len(parts) - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or nxt[i] != j or size != end[j] - start[i] or size > room:
            continue
        end[i], alive[j], nxt[i] = end[j], False, nxt[j]
        last = nxt[i] - 1
        if nxt[i] < len(parts):
            prev[nxt[i]] = i
            heapq.heappush(heap, (parts[last][2], end[nxt[i]] - start[i], i, nxt[i]))
        if prev[i] >= 0:
            heapq.heappush(heap, (parts[i - 1][2], end[i] - start[prev[i]], prev[i], i))
    return [(max(0, start[i] - overlap), start[i], end[i]) for i in range(len(parts)) if alive[i]]


def filetype_key(filetype: Column) -> Column:
    return F.regexp_replace(F.lower(filetype), r"^[\s　]*\.?|[\s　]+$", "")


def oversized(pages: DataFrame, limits: DataFrame) -> DataFrame:
    """(page_id, doc_id, no, text, max_chars, overlap_chars) of the texts above their limit."""
    known = limits.groupBy(filetype_key(F.col("filetype")).alias("kind")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("own"))
    default = known.where("kind = 'default'").select(F.col("own").alias("other"))
    rows = pages.select("page_id", "doc_id", "no", "text", filetype_key(F.col("filetype")).alias("kind")).where("text IS NOT NULL")
    rows = rows.join(known, "kind", "left").join(default, how="left").withColumn("limit", F.coalesce("own", "other"))
    return rows.where("length(text) > limit.max_chars").select("page_id", "doc_id", "no", "text", "limit.max_chars", F.coalesce("limit.overlap_chars", F.lit(0)).alias("overlap_chars"))


PIECES = "page_id bigint, doc_id string, no int, piece_no int, start_char int, new_from int, end_char int, text string"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("doc_id", pa.string()), ("no", pa.int32()), *((c, pa.int32()) for c in ("piece_no", "start_char", "new_from", "end_char")), ("text", pa.string())])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = []
            for page, doc, no, text, limit, overlap in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                rows += [(page, doc, no, k, s, n, e, text[s:e]) for k, (s, n, e) in enumerate(split(text, limit, overlap), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def pieces(pages: DataFrame, limits: DataFrame) -> DataFrame:
    """Numbered pieces of each text above its limit."""
    big = oversized(pages, limits).select(
        F.col("page_id").cast("bigint"), F.col("doc_id").cast("string"), F.col("no").cast("int"), F.col("text"), F.col("max_chars").cast("int"), F.col("overlap_chars").cast("int")
    )
    return big.mapInArrow(cut, PIECES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that come out in more than one piece."""
    return p1_pieces(spark, sf_dir).where("piece_no = 2").select("page_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "extracted_pages"), table(spark, sf_dir, "split_limits"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLES = {
    "p1_found": r"""
WITH l AS (SELECT regexp_replace(lower(trim(filetype)), '^\.', '') AS kind, max_chars FROM split_limits)
SELECT p.page_id FROM extracted_pages p
LEFT JOIN l ON l.kind = regexp_replace(lower(trim(p.filetype)), '^\.', '')
WHERE length(p.text) > coalesce(l.max_chars, (SELECT max_chars FROM l WHERE kind = 'default'))
"""
}
