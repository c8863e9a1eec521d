"""Problem 2: exact numbers of tokens per text, and their totals by project or source, language and category.

Each task splits its texts into the tokenizer's words, a block of texts at a time. A word that occurs in FREQUENT or more
texts of a block is encoded there, once. Of all others one row per block and word is sent, with the texts it occurs in
and how often; rows of a word from TASKS_TOGETHER tasks meet in one partition, which encodes the word once and gives each
text its share. Thus neither a word in every text nor one in some texts of each block gathers more than a bounded number
of entries in a task, at any size. Shares of a text are added up, partially before they travel.

The tokenizer (byte_bpe_50k) normalizes nothing, so words are taken from the texts as stored. Null, empty and missing
texts have 0 tokens and stay in the result. Languages are reported by their lower-case main tag, missing and
undetermined ones as null; projects in the form of problem 4. A file delivered again counts once, by its first delivery
that has a project and category.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.llm.byte_pairs import PATTERN, automaton, vocabulary
from bunko.llm.lookalike import consistent_form_udf
from bunko.session import table

BLOCK_CHARS = 3_000_000
FREQUENT = 32
TASKS_TOGETHER = 64


def words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(word, texts, times): distinct words of a block of texts (text_key, text); the row without a word has the tokens
    that the block's frequent words bring to each text."""
    import regex

    a = automaton(path)
    find = regex.compile(PATTERN).findall
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    keys: list[int] = []
    sizes: list[int] = []
    seen: list[int] = []
    chars = 0

    def block() -> pa.RecordBatch:
        each = (np.array(seen, dtype=np.int64) << 32) | np.repeat(np.arange(len(keys)), sizes)
        each, times = np.unique(each, return_counts=True)
        word, text, spelled = each >> 32, each & 0xFFFFFFFF, list(number)
        n_texts = np.bincount(word, minlength=len(spelled))
        often = np.flatnonzero(n_texts >= FREQUENT)
        a.trim()
        length = np.zeros(len(spelled))
        length[often] = [len(a[spelled[w]]) // 4 for w in often]
        tokens = np.bincount(text, length[word] * times, len(keys)).astype(np.int64)
        rest = n_texts[word] < FREQUENT
        kept = np.flatnonzero(n_texts < FREQUENT)
        offsets = np.concatenate([[0], np.cumsum(n_texts[kept])])
        texts, counts = np.array(keys, dtype=np.int64)[text[rest]], times[rest]
        some = np.flatnonzero(tokens)
        for k in np.array_split(some, max(1, len(some) // 2000)):
            texts, counts, offsets = np.concatenate([texts, np.array(keys, dtype=np.int64)[k]]), np.concatenate([counts, tokens[k]]), np.append(offsets, offsets[-1] + len(k))
        spelled = [spelled[w] for w in kept] + [None] * (len(offsets) - 1 - len(kept))
        lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (texts, counts.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(spelled, pa.string()), *lists], names=["word", "texts", "times"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            own = [number[w] for w in find(text)]
            keys.append(key)
            sizes.append(len(own))
            seen += own
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from _slices(block())
                number.clear()
                keys.clear(), sizes.clear(), seen.clear()
                chars = 0
    if keys:
        yield from _slices(block())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 20_000):
        yield batch.slice(at, 20_000)


def shares(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(text_key, n): tokens that the words of this partition bring to each text."""
    a = automaton(path)
    for batch in batches:
        a.trim()
        length = np.array([1 if w is None else len(a[w]) // 4 for w in batch.column(0).to_pylist()], dtype=np.int64)
        texts, times = batch.column(1), batch.column(2)
        n = np.repeat(length, np.diff(texts.offsets.to_numpy())) * times.flatten().to_numpy()
        key, at = np.unique(texts.flatten().to_numpy(), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, n, len(key)).astype(np.int64))], names=["text_key", "n"])


def token_counts(texts: DataFrame, path: str | None = None) -> DataFrame:
    """(text_key, n_tokens) of the texts (text_key, text) that have any token; keys are unique."""
    path = path or vocabulary()
    found = texts.select(F.col("text_key").cast("bigint"), F.col("text").cast("string")).mapInArrow(lambda it: words(it, path), "word string, texts array<bigint>, times array<int>")
    # rows without a word go anywhere
    place = F.coalesce(F.xxhash64("word"), F.get("texts", F.lit(0))).alias("place")
    found = found.select("word", "texts", "times", place, F.floor(F.spark_partition_id() / TASKS_TOGETHER).alias("group"))
    parts = found.repartition("group", "place").select("word", "texts", "times").mapInArrow(lambda it: shares(it, path), "text_key bigint, n bigint")
    return parts.groupBy("text_key").agg(F.sum("n").alias("n_tokens"))


def language(lang: Column) -> Column:
    main = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})\b", 1))
    return F.when(~main.isin("", "und"), main)


def file_slices(files: DataFrame) -> DataFrame:
    """(doc_id, project, category), one row per doc_id."""
    first = files.groupBy("doc_id").agg(F.min(F.struct(F.col("project").isNull().alias("a"), F.col("category").isNull().alias("b"), "file_id", "project", "category")).alias("f"))
    return first.select("doc_id", consistent_form_udf("f.project").alias("project"), F.col("f.category").alias("category"))


def _slices_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "extracted_pages")
    docs = table(spark, sf_dir, "documents")
    # page keys even, document keys odd
    texts = pages.select((F.col("page_id") * 2).alias("text_key"), "text").unionByName(docs.select((F.col("doc_id") * 2 + 1).alias("text_key"), "text"))
    of_pages = pages.select((F.col("page_id") * 2).alias("text_key"), F.lit("extracted_pages").alias("table"), F.col("page_id").alias("id"), "doc_id", language(F.col("lang")).alias("lang"), F.length("text").alias("n_chars"))
    of_pages = of_pages.join(file_slices(table(spark, sf_dir, "corpus_files")), "doc_id", "left").select("text_key", "table", "id", F.col("project").alias("slice"), "lang", "category", "n_chars")
    of_docs = docs.select((F.col("doc_id") * 2 + 1).alias("text_key"), F.lit("documents").alias("table"), F.col("doc_id").alias("id"), F.col("source").alias("slice"), language(F.col("lang")).alias("lang"), "category", F.length("text").alias("n_chars"))
    return texts, of_pages.unionByName(of_docs)


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, slices = _slices_of(spark, sf_dir)
    return slices.join(token_counts(texts), "text_key", "left").select("table", "id", "slice", "lang", "category", "n_chars", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, characters and tokens by table, project or source (slice), language and category."""
    return p2_texts(spark, sf_dir).groupBy("table", "slice", "lang", "category").agg(
        F.count("*").alias("n_texts"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("n_chars"), F.sum("n_tokens").alias("n_tokens")
    )


QUERIES = {"p2_totals": p2_totals, "p2_texts": p2_texts}
ORACLES: dict[str, str] = {}
