"""Lexical, dense and fused retrieval for many queries at once; every table is keyed by the query."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bunko.functions.text import tokens
from bunko.session import materialize, spread

K1, B, EPSILON, POOL, RRF = 1.5, 0.75, 0.25, 200, 60
# Queries and vectors that meet in a task, and vectors worked on at once.
QUERY_BLOCK, VECTOR_GROUP, CHUNK = 256, 16_384, 4096
# Most (query, term) rows that are broadcast, about 40 bytes each.
BROADCAST_TERMS = 100_000
# Many lexical queries: queries and documents that meet in a task, documents packed into one row, scored at once.
LEXICAL_QUERIES, LEXICAL_GROUP, PACKED, SCORED = 16_384, 131_072, 1000, 16_384
# Scores closer than this to the last place are left for the final ranking, which rounds them.
CLOSE = 2e-9


@dataclass
class Index:
    """A lexical index: postings (id, dl, term, tf), which hold each document once more without a term, and the terms
    (term, df, idf) and totals (n, avgdl) made of them."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame

    def save(self, path: str) -> None:
        for name in ("postings", "terms", "totals"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """The index written to a folder; one whose totals disagree with its postings is refused."""
        index = cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "totals")))
        n, held = index.totals.first().n, index.postings.where("term IS NULL").count()
        if n != held:
            raise ValueError(f"index holds {held} documents, its totals say {n}")
        return index


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, term, tf); each document also has a row with a null term. The texts are read once."""
    terms = docs.select(F.col(id_col).alias("id"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
    each = terms.select("id", F.size("t").alias("dl"), F.explode(F.concat("t", F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def term_statistics(posted: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf becomes EPSILON times the mean over all terms before that."""
    return inverse_frequencies(posted.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")), totals)


def inverse_frequencies(df: DataFrame, totals: DataFrame) -> DataFrame:
    df = df.crossJoin(F.broadcast(totals))
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def build(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of all documents, its tables written to the shared folder; n counts documents without terms too."""
    posted = materialize(postings(spread(docs.select(id_col, text_col)), id_col, text_col))
    totals = materialize(posted.where("term IS NULL").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    return Index(posted, materialize(term_statistics(posted, totals)), totals)


def matches(df: DataFrame, project: str = "", category: str = "", filetype: str = "", mount: str = "") -> DataFrame:
    """Rows whose project, category and mount contain the wanted text, whatever its case, and whose filetype is one of a
    list; an empty argument asks for nothing, null columns are empty."""
    for name, part in (("project", project), ("category", category), ("mount", mount)):
        if part:
            df = df.where(F.lower(F.coalesce(name, F.lit(""))).contains(part.lower()))
    kinds = [k.strip().lower().lstrip(".") for k in filetype.split(",")] if filetype else []
    return df.where(F.ltrim(F.lower(F.trim("filetype")), F.lit(".")).isin(kinds)) if kinds else df


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query with their rank0; the limit on the rank reaches the tasks before the exchange."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return scored.withColumn("_rank", rank).where(F.col("_rank") <= k).withColumn("rank0", F.col("_rank") - 1).drop("_rank")


def bm25(index: Index, queries: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank0): the best k of each query (qid, query), over statistics of all documents.

    Repeated query terms count repeatedly. `keep` (id) only removes candidates. Few query terms go to the postings,
    many are joined by shuffling both; ties are ranked by id.
    """
    asked = queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda df: df)
    weighed = small(index.terms.join(small(asked), "term").select("qid", "term", (F.col("times") * F.col("idf")).alias("weight")))
    found = index.postings.where("term IS NOT NULL").join(weighed, "term").crossJoin(F.broadcast(index.totals))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = found.groupBy("qid", "id").agg(F.sum(part).alias("score")).where("score > 0")
    if keep is not None:
        out = out.join(keep, "id", "left_semi")
    return top(out, min(k, POOL), F.round("score", 9).desc(), F.col("id"))


PACKED_TYPE = "first bigint, n bigint, length bigint, ids binary, lengths binary, kept binary, counts binary, terms array<string>, codes binary, tfs binary"


def pack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, t, kept) in rows of PACKED each: their terms once, and per document its ascending term numbers with
    their frequencies."""
    for whole in batches:
        for at in range(0, whole.num_rows, PACKED):
            b = whole.slice(at, PACKED)
            t = b.column(1)
            lengths = np.diff(t.offsets.to_numpy()).astype(np.int32)
            coded = t.flatten().dictionary_encode()
            width = max(len(coded.dictionary), 1)
            both, tf = np.unique(np.repeat(np.arange(b.num_rows, dtype=np.int64), lengths) * width + coded.indices.to_numpy(), return_counts=True)
            doc, code = np.divmod(both, width)
            ids = b.column(0).to_numpy()
            squeeze = lambda x: zlib.compress(x.astype(np.int32).tobytes(), 1)
            row = [[int(ids[0])], [len(ids)], [int(lengths.sum())], [ids.tobytes()], [lengths.tobytes()], [b.column(2).to_numpy(zero_copy_only=False).tobytes()], [np.bincount(doc, minlength=len(ids)).astype(np.int32).tobytes()], [coded.dictionary.to_pylist()], [squeeze(np.diff(code, prepend=0))], [squeeze(tf)]]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4 + [pa.list_(pa.string())] + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["first", "n", "length", "ids", "lengths", "kept", "counts", "terms", "codes", "tfs"])


def _ints(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype=np.int32)


def packed_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each batch of packed documents."""
    for b in batches:
        df = [np.bincount(np.cumsum(_ints(c.as_py())), minlength=len(t)) for c, t in zip(b.column("codes"), b.column("terms"))]
        if df:
            both = pa.table({"term": b.column("terms").flatten(), "df": np.concatenate(df)}).group_by("term").aggregate([("df", "sum")])
            yield from both.rename_columns({"term": "term", "df_sum": "df"}).select(["term", "df"]).to_batches()


def pack_queries(rows: pa.Table) -> pa.Table:
    """The (block, qid, term, weight) of a block of queries in one row."""
    rows = rows.sort_by("qid")
    qid, counts = np.unique(rows.column("qid").to_numpy(), return_counts=True)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    return pa.table({
        "block": rows.column("block")[:1], "qids": pa.array([qid.tobytes()], pa.binary()), "counts": pa.array([counts.astype(np.int32).tobytes()], pa.binary()), "terms": pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
        "codes": pa.array([coded.indices.to_numpy().astype(np.int32).tobytes()], pa.binary()), "weights": pa.array([rows.column("weight").to_numpy().astype(np.float64).tobytes()], pa.binary()),
    })


def _unpacked(held: pa.Table, wanted: pa.Array, avgdl: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some packed documents the ids that are kept, ascending, and of their postings in the wanted terms, by term: where
    each term begins, the document's place and the term's share of a score without its weight."""
    read = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in held.column(c)])
    ids, lengths, kept, counts = read("ids", np.int64), read("lengths", np.int32), read("kept", bool), read("counts", np.int32)
    terms = held.column("terms").combine_chunks()
    number = pa.compute.fill_null(pa.compute.index_in(terms.flatten(), value_set=wanted), -1).to_numpy()
    starts = np.cumsum([0, *np.diff(terms.offsets.to_numpy())])
    # numbers ascend within a document only: their steps are summed up over each row
    term = np.concatenate([number[s + np.cumsum(_ints(c.as_py()))] for s, c in zip(starts, held.column("codes"))] or [np.zeros(0, dtype=np.int64)])
    tf = np.concatenate([_ints(x.as_py()) for x in held.column("tfs")])
    doc = np.repeat(np.arange(len(ids)), counts)
    here = np.flatnonzero((term >= 0) & kept[doc])
    order = np.flatnonzero(kept)[np.argsort(ids[kept], kind="stable")]
    place = np.zeros(len(ids), dtype=np.int32)
    place[order] = np.arange(len(order))
    here = here[np.argsort(term[here], kind="stable")]
    tf, doc = tf[here], doc[here]
    share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / avgdl))
    return ids[order], np.searchsorted(term[here], np.arange(len(wanted) + 1)), place[doc], share


def lexical(held: pa.Table, asked: pa.Table, k: int, avgdl: float) -> pa.Table:
    """The best k documents of one group for each query of one block, with those that may tie with the last."""
    kind = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    if not held.num_rows or not asked.num_rows:
        return kind.empty_table()
    read = lambda c, kind: np.frombuffer(asked.column(c)[0].as_py(), dtype=kind)
    qids, codes, weights = read("qids", np.int64), read("codes", np.int32), read("weights", np.float64)
    ends = np.cumsum(read("counts", np.int32))
    wanted = asked.column("terms").combine_chunks().flatten()
    best, least = np.full((len(qids), k), -np.inf), np.zeros(len(qids))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, SCORED // PACKED)
    for at in range(0, held.num_rows, step):
        ids, starts, doc, share = _unpacked(held.slice(at, step), wanted, avgdl)
        if not len(ids):
            continue
        for q, (i, j) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            a, b, w = starts[codes[i:j]], starts[codes[i:j] + 1], weights[i:j]
            runs = [slice(x, y) for x, y in zip(a.tolist(), b.tolist()) if y > x]
            if not runs:
                continue
            score = np.bincount(np.concatenate([doc[r] for r in runs]), np.concatenate([share[r] for r in runs]) * np.repeat(w, b - a), len(ids))
            hit = np.flatnonzero(score > max(least[q] - CLOSE, 0))
            if not len(hit):
                continue
            score = score[hit]
            if len(score) > k:
                near = np.flatnonzero(score >= np.partition(score, -k)[-k] - CLOSE)
                hit, score = hit[near], score[near]
            both = np.concatenate([best[q], score])
            best[q] = np.partition(both, -k)[-k:]
            least[q] = best[q].min()
            found.append((np.full(len(hit), q), ids[hit], score))
    if not found:
        return kind.empty_table()
    q, ids, score = (np.concatenate(x) for x in zip(*found))
    last = score > np.maximum(least[q] - CLOSE, 0)
    return pa.table([qids[q[last]], ids[last], score[last]], schema=kind)


def bm25_many(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As `bm25`, for any number of queries, of documents (id, text, kept), of which those not kept only count in the
    statistics.

    The documents are packed once, a thousand a row, by their own terms; blocks of packed queries meet groups of packed
    documents in tasks of bounded size, which add up scores and hand on their best k per query. No posting becomes a row.
    """
    rows = spread(docs).select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"), F.coalesce("kept", F.lit(False)).alias("kept"))
    packed = materialize(rows.mapInArrow(pack_documents, PACKED_TYPE))
    n, length = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("length")).first()
    avgdl = (length or 0) / max(n, 1)
    totals = packed.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n"))
    df = packed.select("terms", "codes").mapInArrow(packed_frequencies, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    terms = inverse_frequencies(df, totals)
    n_queries = queries.count()
    n_blocks = max(1, -(-n_queries // LEXICAL_QUERIES))
    n_groups = max(2 * packed.sparkSession.sparkContext.defaultParallelism, -(-n // LEXICAL_GROUP))
    place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    times = spread(queries).select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    weighed = times.join(terms, "term").select(place("qid", n_blocks).alias("block"), F.col("qid").cast("bigint"), "term", (F.col("times") * F.col("idf")).alias("weight"))
    asked = weighed.groupBy("block").applyInArrow(pack_queries, "block int, qids binary, counts binary, terms array<string>, codes binary, weights binary")
    held = packed.select("ids", "lengths", "kept", "counts", "terms", "codes", "tfs", every(n_blocks).alias("block"), place("first", n_groups).alias("group"))
    asked = materialize(asked).withColumn("group", every(n_groups))
    found = held.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(lambda d, q: lexical(d, q, min(k, POOL), avgdl), "qid bigint, id bigint, score double")
    return top(found, min(k, POOL), F.round("score", 9).desc(), F.col("id"))


def nearest(vectors, queries, k: int):
    """The best k of one group of vectors for one block of queries; `near` is the score in the form it is ranked by."""
    def matrix(column):
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1)

    kind = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("near", pa.float64())])
    if not vectors.num_rows or not queries.num_rows:
        return kind.empty_table()
    qid, q = queries.column("qid").to_numpy(), matrix(queries.column("q"))
    # in the order of ids, so that a stable sort leaves ties in it
    vectors = vectors.sort_by("id")
    top_id, top, top_near = np.zeros((len(qid), 0), dtype=np.int64), *np.zeros((2, len(qid), 0))
    for at in range(0, vectors.num_rows, CHUNK):
        part = vectors.slice(at, CHUNK)
        scores = q @ matrix(part.column("v")).T
        scores[~np.isfinite(scores)] = -np.inf
        ids = np.broadcast_to(part.column("id").to_numpy(), scores.shape)
        top_id, top, top_near = (np.concatenate(x, axis=1) for x in ((top_id, ids), (top, scores), (top_near, np.round(scores, 9))))
        best = np.argsort(-top_near, axis=1, kind="stable")[:, :k]
        top_id, top, top_near = (np.take_along_axis(x, best, axis=1) for x in (top_id, top, top_near))
    out = pa.table([np.repeat(qid, top.shape[1]), top_id.ravel(), top.ravel(), top_near.ravel()], schema=kind)
    return out.filter(pa.array(np.isfinite(top_near.ravel())))


def dense(vectors: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """(qid, id, score, rank0): nearest vectors (id, v) by dot product for any number of query vectors (qid, q);
    scores that are not finite are left out.

    Queries fall into blocks and vectors into groups by hash; each block meets each group in a task of bounded size, which
    keeps the best k per query. The driver gets two numbers of rows.
    """
    vectors = vectors.where("v IS NOT NULL").select(F.col("id").cast("bigint"), "v")
    queries = queries.where("q IS NOT NULL").select(F.col("qid").cast("bigint"), "q")
    n_blocks, n_groups = (max(1, -(-x.count() // size)) for x, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_GROUP)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select("qid", "q", place("qid", n_blocks).alias("block"), every(n_groups).alias("group"))
    held = vectors.select("id", "v", every(n_blocks).alias("block"), place("id", n_groups).alias("group"))
    near = held.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(lambda v, q: nearest(v, q, k), "qid bigint, id bigint, score double, near double")
    return top(near, k, F.desc("near"), F.col("id")).drop("near")


def fuse(lexical: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, id, rank0); of equal scores the larger id comes first."""
    a, b = lexical.select("qid", "id", F.col("rank0").alias("a")), near.select("qid", "id", F.col("rank0").alias("b"))
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", "id"], "full").select("qid", "id", F.round(part("a") + part("b"), 6).alias("score"))
    return top(both, k, F.desc("score"), F.desc("id"))


def grep(docs: DataFrame, id_col: str, text_col: str, pattern: str, width: int = 220) -> DataFrame:
    """(id, line_no, line): lines that match, trimmed and cut to a width for display."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), r"\r\n|\r|\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("id", (F.col("at") + 1).alias("line_no"), F.substring(F.trim("line"), 1, width).alias("line"))


def best_lines(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy("id", "line_no").limit(limit)
