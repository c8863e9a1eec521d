"""Problem 8: statistics of each document's text, and how far they lie from the natural prose of its language.

One pass measures each text: number of words, mean word length, share of symbols, share of lines that end in
punctuation, share of common words, and the shares of its characters in lines shaped as list, table, code or unreadable.
The prose of a language is described by a robust mean and covariance of these statistics over all its documents, prose
or not: the minimum covariance determinant, found by concentration steps (the half of the documents nearest to the
present mean gives the next mean and covariance, ROUNDS times), then reweighted once over all documents that lie inside.
No step looks at what kind a document seems to be. All of it is aggregated by Spark; what the driver gets is a row per
language. The distance of a document is the Mahalanobis distance to its language's prose; the part of each statistic in
it is reported, and the parts add up to the squared distance.

A document with content is not prose exactly if its squared distance exceeds CUTOFF. Its kind is then the one whose share
deviates most from its language's prose. Labels of raters fit nothing; the tests compare with them.

Words of Chinese and Japanese aren't marked in the text: a word is taken as at most two ideographs or four hiragana.

Null, empty and blank texts have null statistics and no kind. A language that is missing, undetermined or not in the
list of common words is told from the text's characters and common words. A language with fewer than LEAST_DOCUMENTS is
compared with the documents of all languages together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.session import materialize, spread, table

STATISTICS = ["log_words", "mean_word_length", "symbol_share", "punctuated_lines", "common_share", "list_share", "table_share", "code_share", "junk_share"]
KINDS = ["list", "table", "code", "junk"]
# Squared distance that a normal vector of nine statistics exceeds once in a thousand times.
CUTOFF = 27.9
# Least spread of each statistic, so that one which hardly varies in prose doesn't outweigh all others.
FLOOR = np.array([0.5, 0.5, 0.02, 0.2, 0.05, 0.1, 0.1, 0.1, 0.05])
LEAST_DOCUMENTS = 30
ROUNDS = 3
# Fixed values of the chi-square distribution of nine degrees: the 0.975 quantile, and the factor that makes the
# covariance of the nearest half consistent.
INSIDE, HALF_FACTOR = 19.02, 1.57

_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[一-龥々]{1,2}|[ァ-ヺー]+|[ぁ-ゖ]{1,4}|\d+")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_HIRAGANA, _IDEOGRAPH = re.compile(r"[ぁ-ゖ]"), re.compile(r"[一-龥]")
_END = re.compile(r"[。．.!?！？…:：;；][」』）)\]”’\"'*`]*$")
_SENTENCE_END = re.compile(r"[。．.!?！？…][」』）)\]”’\"'*`]*$")
_BULLET = re.compile(r"^\s*(?:[-*+–—]\s+|[•・■□◆◇○●◎▪▫→►★☆※]\s*|[(（]?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)）、]\s+|[①-⑳]\s*|\[[ xX]\]\s+)\S")
_LEADER = re.compile(r"(?:\.{3,}|…{2,}|・{3,}|_{3,}|\s{3,})\s*\d+$")
_NAMED = re.compile(r"^[^\s:：=|,;{}()]{1,40}(?: [^\s:：=|,;{}()]{1,30}){0,3}\s*[:：]\s*[^{}\[\]\"';]{1,80}$")
_CODE = re.compile(
    r"^\s*(?:import [\w.]+|from [\w.]+ import |def \w+\(|class \w+|return\b|for \w+ in |for \(|while\b.*[:({]|if .*[:{)]$|if \[|elif |else:|else \{|try:|except\b|with .* as |print\(|raise |assert |yield |lambda |"
    r"export \w+=|SELECT |INSERT INTO |UPDATE \w+ SET|DELETE FROM|CREATE (?:TABLE|VIEW|INDEX)|FROM \w+|WHERE |GROUP BY|ORDER BY|JOIN |mkdir |cp |mv |rm -|cd |curl |wget |git |sudo |echo |chmod |grep |pip |docker |"
    r"#!|#include|\$ |function \w*\(|const |let |var |public |private |static |void |int \w+|fi$|done$|then$|do$|end$|@\w+|</?\w+[^>]*>|//|/\*|--\w)"
)
_CODE_SHAPE = re.compile(r"[{};]\s*$|^\s*[}\])]+[,;]?$|^\s*\[[\w.\-\"']+\]\s*$|^\s*[\"']?[\w.\-]+[\"']?\s*[=:]\s*[\[{\"'(].*|^\s*[\w.\[\]'\"]+\s*(?:=|\+=|-=|:=)\s*\S|\w+\([^()]*\)\s*[:;{]?$|\{\"|\": |&& | \|\| |; do | done$")
_PAIR = re.compile(r"[\"']\s*:\s*[\[{\"'\d]")
_RULE = re.compile(r"^[|+\-:=\s｜]*[-=]{2,}[|+\-:=\s｜]*$")
_HEX = re.compile(r"^\s*(?:[0-9a-fA-F]{4,16}:?\s+)?(?:[0-9a-fA-F]{2}\s+){4,}[0-9a-fA-F]{2}\b|^\s*[0-9a-fA-F]{6,16}:?\s+(?:[0-9a-fA-F]{2,4}\s*)+$")
_ENCODED = re.compile(r"^\s*[A-Za-z0-9+/_\-]{16,}={0,2}\s*$")
_LOST = re.compile(r"[�□¿¤�]")
_MOJIBAKE = re.compile(r"[\u0080-\u009f]|[ÃÂâãäåæçèéêëìíîïð][\u0080-¿]")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}|^[^aeiouyäöüé]{3,}$", re.I)
_SEPARATORS = ("\t", "|", "｜", ",", ";", "，", "；")
_GAP = re.compile(r"[ 　]{2,}")
_LETTERS = re.compile(r"[ぁ-ゖァ-ヺー一-龥々A-Za-z]+")
_ALNUM = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r'"[^"\n]*"')


def detect(text: str, common: dict[str, frozenset]) -> str:
    """Language of the whole text."""
    kana, han = len(_HIRAGANA.findall(text)), len(_IDEOGRAPH.findall(text))
    if kana * 20 > len(text) or kana and kana * 4 > han:
        return "ja"
    if han * 5 > len(text):
        return "zh"
    seen = Counter(w.lower() for w in _LATIN.findall(text))
    hits = {k: sum(seen[w] for w in v) for k, v in common.items() if k not in ("ja", "zh")}
    return max(sorted(hits), key=hits.get) if hits and max(hits.values()) else "ja" if kana or re.search(r"[ァ-ヺ]", text) else "en"


class Meter:
    """Measures texts; common: the frequent words by language."""

    def __init__(self, common: dict[str, list[str]]):
        self.common = {k: frozenset(w.lower() for w in v) for k, v in common.items()}
        self.runs = {k: re.compile("|".join(re.escape(w) for w in sorted(v, key=lambda w: (-len(w), w)))) for k, v in self.common.items() if k in ("ja", "zh") and v}

    def common_share(self, text: str, lang: str) -> float:
        if lang in self.runs:
            letters = sum(map(len, _LETTERS.findall(text)))
            return sum(map(len, self.runs[lang].findall(text))) / letters if letters else 0.0
        words = _LATIN.findall(text.lower())
        own = self.common.get(lang, frozenset())
        return sum(w in own for w in words) / len(words) if words else 0.0

    @staticmethod
    def _few_letters(line: str) -> bool:
        return sum(map(len, _ALNUM.findall(line))) * 5 < sum(map(len, line.split())) * 2

    def _junk(self, line: str, damaged: bool = True) -> bool:
        n = len(line)
        body = line[2:] if line[:2] in ("□ ", "■ ") else line
        if damaged and (len(_LOST.findall(body)) * 12 > n and n > 3 or len(_MOJIBAKE.findall(line)) * 8 > n):
            return True
        if _HEX.match(line) or _ENCODED.match(line) and n >= 24 and (re.search(r"[A-Z]", line) and re.search(r"[a-z]", line) and re.search(r"\d|[+/]", line)):
            return True
        if n >= 8 and len(set(line) - {" "}) <= 2 and not _RULE.match(line) or n >= 20 and len(set(line)) == 1:
            return True
        if n >= 4 and self._few_letters(line) and not _RULE.match(line) and not _LEADER.search(line):
            return True
        words = [] if _SENTENCE_END.search(line) else [w for w in _LATIN.findall(line) if len(w) > 2]
        if len(words) >= 4 and sum(map(len, words)) * 2 > n and sum(bool(_CLUSTER.search(w)) for w in words) * 3 > len(words):
            known = sum(w.lower() in c for w in words for k, c in self.common.items() if k not in ("ja", "zh"))
            if known * 6 < len(words):
                return True
        tokens = line.split()
        return len(tokens) >= 4 and sum(len(t) <= 2 and not t.isalnum() or t in ("l", "I1", "ﾉ") for t in tokens) * 10 > len(tokens) * 7

    def _table(self, lines: list[str], ended: list[bool]) -> list[bool]:
        out = [False] * len(lines)
        if len(lines) < 3:
            return out
        bare = [_QUOTED.sub("q", x) if '"' in x else x for x in lines]
        whole = "\n".join(bare)
        for sep in _SEPARATORS:
            if whole.count(sep) < 3:
                continue
            counts = [x.count(sep) for x in bare]
            least = 1 if sep in "\t｜|" else 2
            usual = Counter(c for c, e in zip(counts, ended) if c >= least and (not e or sep in "\t|｜"))
            for k, rows in usual.items():
                if rows >= 3:
                    for i, c in enumerate(counts):
                        cells = lines[i].split(sep)
                        if c == k and (sep in "\t|｜" or not ended[i] and sum(map(len, cells)) <= 24 * len(cells)):
                            out[i] = True
        gaps = [len(_GAP.findall(x)) if "  " in x or "\u3000" in x else 0 for x in lines]
        wide = [i for i, g in enumerate(gaps) if g >= 2 and not _LEADER.search(lines[i]) and not ended[i]]
        if len(wide) >= 3:
            for i, g in enumerate(gaps):
                if g and not ended[i] and not _LEADER.search(lines[i]):
                    out[i] = True
        return out

    def shares(self, text: str, lang: str) -> dict[str, float]:
        """Share of the characters in lines of the shape of list, table, code and junk."""
        raw = [x.rstrip() for x in re.split(r"\r\n|[\n\r\x0b\x0c  \x85]", text) if x.strip()]
        lines = [x.strip("﻿​ 　") for x in raw]
        often = Counter(lines)
        ended = [bool(_SENTENCE_END.search(x)) for x in raw]
        tables = self._table(raw, ended)
        damaged = bool(_LOST.search(text) or _MOJIBAKE.search(text))
        weight: Counter = Counter()
        kinds: list[str] = []
        for line, full, is_table, end in zip(lines, raw, tables, ended):
            n = len(line)
            if often[line] >= 3 and often[line] * 2 > len(lines) and n > 3:
                kind = "junk"
            elif end and n >= 24 and not is_table and not damaged and not self._few_letters(line) and not _CODE.match(full) and not _LEADER.search(line):
                kind = "prose" if not line.startswith("#") else "heading"
            elif _RULE.match(line) and len(set(line)) > 1:
                kind = "table" if "|" in line else "rule"
            elif is_table and not (_CODE.match(full) or _PAIR.search(line) or self._few_letters(line) or _HEX.match(line) or _ENCODED.match(line)):
                kind = "table"
            elif self._junk(line, damaged):
                kind = "junk"
            elif _CODE.match(full) or _CODE_SHAPE.search(full) and not _SENTENCE_END.search(line) and not _BULLET.match(line):
                kind = "code"
            elif line.startswith("#") and n < 120:
                kind = "comment" if full != line else "heading"
            elif _LEADER.search(line) or _BULLET.match(full) and not (_SENTENCE_END.search(line) and n > 24):
                kind = "list"
            elif _SENTENCE_END.search(line) and n >= 8:
                kind = "prose"
            elif _NAMED.match(line):
                kind = "list"
            elif n >= 50:
                kind = "prose"
            else:
                kind = "entry"
            kinds.append(kind)
            weight[kind] += n
        if weight["comment"]:
            weight["code" if weight["code"] else "heading"] += weight["comment"]
        if kinds.count("entry") >= 3 and weight["entry"] > weight["prose"]:
            weight["list"] += weight["entry"]
        total = sum(weight[k] for k in ("prose", *KINDS))
        if not total:
            return dict.fromkeys(KINDS, 0.0)
        return {k: weight[k] / total for k in KINDS}

    def measure(self, text: str | None, lang: str | None) -> dict | None:
        if text is None or not re.search(r"[^\s\x00-\x1f\x7f-\x9f\xad​-‏ -‮⁠-⁤﻿]", text):
            return None
        kind = lang if lang in self.common else detect(text, self.common)
        words = _WORD.findall(text)
        visible = sum(map(len, text.split()))
        lines = [x.strip() for x in re.split(r"[\r\n]+", text) if x.strip()]
        out = {
            "language": kind, "n_words": len(words), "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
            "symbol_share": len(re.findall(r"[^\w\s]|_", text)) / max(visible, 1), "punctuated_lines": sum(bool(_END.search(x)) for x in lines) / max(len(lines), 1),
            "common_share": self.common_share(text, kind),
        }
        out["log_words"] = float(np.log1p(len(words)))
        return out | {f"{k}_share": v for k, v in self.shares(text, kind).items()}


MEASURED = [("language", pa.string()), ("n_words", pa.int64()), *((c, pa.float64()) for c in STATISTICS)]


def statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, has_content, language, n_words, statistics...) of each document; the common words are a
    list of fixed size."""
    common: dict[str, list[str]] = {}
    for r in common_words.where("lang IS NOT NULL AND word <> ''").select("lang", "word").distinct().collect():
        common.setdefault(r.lang.lower(), []).append(r.word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(common)
        for b in batches:
            rows = [meter.measure(t, g) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array([None if r is None else r[c] for r in rows], kind) for c, kind in MEASURED]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r is not None for r in rows]), *columns], names=["doc_id", "has_content", *(c for c, _ in MEASURED)])

    main = F.lower(F.regexp_extract(F.col("lang").cast("string"), r"^\s*([A-Za-z]{2,3})\b", 1))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), main.alias("lang"))
    return spread(rows).mapInArrow(run, "doc_id bigint, has_content boolean, language string, n_words bigint, " + ", ".join(f"{c} double" for c, _ in MEASURED[2:]))


def _names(prefix: str) -> list[str]:
    return [f"{prefix}_{c}" for c in STATISTICS]


Shape = dict[str, tuple[np.ndarray, np.ndarray]]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.nan_to_num(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS]).astype(float))


def squares(x: np.ndarray, languages: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Deviation of each row from its language's prose, and the parts of its squared distance."""
    off, parts = np.zeros_like(x), np.zeros_like(x)
    of = np.array([v if v in shape else "" for v in languages], dtype=object)
    for k in set(of):
        mean, inverse = shape.get(k) or (np.zeros(len(STATISTICS)), np.diag(1 / FLOOR**2))
        off[of == k] = x[of == k] - mean
        parts[of == k] = off[of == k] * (off[of == k] @ inverse)
    return off, parts


def _near(measured: DataFrame, shape: Shape) -> DataFrame:
    """(language, distance2)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column("language").to_pylist(), dtype=object)
            yield pa.RecordBatch.from_arrays([b.column("language"), pa.array(squares(_matrix(b), lang, shape)[1].sum(axis=1))], names=["language", "distance2"])

    return measured.select("language", *STATISTICS).mapInArrow(run, "language string, distance2 double")


def _moments(measured: DataFrame, shape: Shape, limit: dict[str, float]) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Number, sums and sums of products of the documents of each language within its limit; one row a task and
    language is added up."""
    size = len(STATISTICS)
    upper = np.triu_indices(size)
    columns = ["n", *(f"s{i}" for i in range(size)), *(f"p{i}" for i in range(len(upper[0])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            lang, x = np.array(b.column("language").to_pylist(), dtype=object), _matrix(b)
            kept = squares(x, lang, shape)[1].sum(axis=1) <= np.array([limit.get(k, np.inf) for k in lang])
            for k in set(lang[kept]):
                own = x[kept & (lang == k)]
                total[k] = total.get(k, 0) + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), *map(pa.array, np.array(list(total.values())).T)], names=["language", *columns])

    rows = measured.select("language", *STATISTICS).mapInArrow(run, "language string, " + ", ".join(f"{c} double" for c in columns))
    out = {}
    for r in rows.groupBy("language").agg(*(F.sum(c).alias(c) for c in columns)).collect():
        product = np.zeros((size, size))
        product[upper] = r[1 + 1 + size :]
        out[r.language] = int(r.n), np.array(r[2 : 2 + size]), product + np.triu(product, 1).T
    return out


def _shape(moments: dict[str, tuple[int, np.ndarray, np.ndarray]], factor: float) -> Shape:
    """Mean and inverse covariance of each language with enough documents, and of all together ('')."""
    together = tuple(sum(m[i] for m in moments.values()) for i in range(3)) if moments else None
    out: Shape = {}
    for k, m in [*moments.items(), *([("", together)] if together else [])]:
        n, total, product = m
        if k == "" or n >= LEAST_DOCUMENTS:
            mean = total / n
            out[k] = mean, np.linalg.inv(factor * (product / n - np.outer(mean, mean)) + np.diag(FLOOR**2))
    return out


def prose_shape(measured: DataFrame) -> Shape:
    """Robust mean and inverse covariance of each language's prose, from all its documents."""
    rows = measured.where("has_content")
    size = {r.language: r for r in rows.groupBy("language").agg(F.count("*").alias("n"), *(F.percentile_approx(c, 0.5, 2000).alias(c) for c in STATISTICS)).collect()}
    shape: Shape = {k: (np.array([r[c] for c in STATISTICS], dtype=float), np.diag(1 / FLOOR**2)) for k, r in size.items() if r.n >= LEAST_DOCUMENTS}
    if size:  # all languages together, for those with too few documents
        most = max(size.values(), key=lambda r: (r.n, r.language))
        shape[""] = np.array([most[c] for c in STATISTICS], dtype=float), np.diag(1 / FLOOR**2)
    for _ in range(ROUNDS):
        half = {r.language: r.d for r in _near(rows, shape).groupBy("language").agg(F.percentile_approx("distance2", 0.5, 2000).alias("d")).collect()}
        shape = _shape(_moments(rows, shape, half), HALF_FACTOR)
    return _shape(_moments(rows, shape, dict.fromkeys(size, INSIDE)), 1.0) or shape


def distances(measured: DataFrame, shape: Shape) -> DataFrame:
    """Adds the part of each statistic in the squared distance, the distance2 they add up to, and the kind."""
    own = [STATISTICS.index(f"{k}_share") for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, parts = squares(_matrix(b), np.array(b.column("language").to_pylist(), dtype=object), shape)
            total = parts.sum(axis=1)
            most = off[:, own].argmax(axis=1)
            kind = np.where(total > CUTOFF, np.array(KINDS, dtype=object)[most], "prose")
            absent = ~b.column("has_content").to_numpy(zero_copy_only=False)
            columns = [pa.array(v, mask=absent) for v in (*parts.T, total, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *_names("part"), "distance2", "kind"])

    added = ", ".join(f"{c} double" for c in (*_names("part"), "distance2")) + ", kind string"
    return measured.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in measured.dtypes) + ", " + added)


def quality(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    measured = materialize(statistics(docs, common_words))
    return distances(measured, prose_shape(measured))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics}
ORACLES: dict[str, str] = {}
