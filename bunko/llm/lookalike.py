"""Problem 4: one form for text that looks the same but differs in its characters.

The form of a value is a skeleton: canonical decomposition, each character replaced by the prototype of its shape,
canonical decomposition again. Two values look the same exactly if their skeletons are equal. `consistent_form` is the
skeleton composed again (NFC), the form in which other operators compare values.

Width forms, all kinds of one space, hyphens, characters without width, composed and decomposed letters and letters of
other scripts or blocks with the same shape fall together. Letter case, accents, voicing marks, raised and circled
digits, line breaks and the number of spaces stay visible; the kinds of one line break (CR LF, CR, LF, U+0085, U+2028,
U+2029) fall together. A joiner between two pictographs changes their look and is kept.

Null stays null, a text without any visible character gets a form of white space only and has no content.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bunko.session import materialize, table

# Letters of other scripts and the Latin letters of the same shape, by script.
SAME_SHAPE = {
    # Cyrillic
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "г": "r",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    # Armenian
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L",
    # Greek and Coptic
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "σ": "o", "ϳ": "j", "Ϳ": "J", "ϲ": "c", "Ϲ": "C",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin
    "ı": "i", "ɡ": "g", "ɑ": "a", "µ": "μ",
    # ideographs and hiragana of the shape of katakana, which are the ones that take voicing marks
    "口": "ロ", "二": "ニ", "力": "カ", "工": "エ", "八": "ハ", "夕": "タ", "卜": "ト", "丿": "ノ", "へ": "ヘ",
    # signs
    "∶": ":", "⁄": "/", "∕": "/", "∼": "~", "〜": "~", "‧": "·", "∙": "·", "⋅": "·", "ꞏ": "·", "∗": "*", "∣": "|", "ǀ": "|", "․": ".",
}
# Hyphens.
HYPHENS = "\u2010\u2011\u2012\u2043\u2212\ufe63\uff0d"
# Marks without width that are not in the format category.
NO_WIDTH = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f"
LINE_BREAKS = "\r\u0085\u2028\u2029"
_JOINER = "\u200d"
# Tags and selectors beyond the basic plane; a class of their own, as one class with both planes is matched far slower.
_TAGS = re.compile("[\U000e0000-\U000e01ef]+")
# Letters and digits in the styles of mathematics, whose compatibility form is the plain letter.
_LETTERS = re.compile("[\U0001d400-\U0001d7ff]+")


@lru_cache(maxsize=1)
def _prototypes() -> tuple[dict[str, str], re.Pattern]:
    """Prototype of each replaced character; width forms and ideographic radicals come from the Unicode data."""
    to: dict[str, str] = {}
    for o in range(0x80, 0x10000):
        ch = chr(o)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            to[ch] = " "
        elif kind == "Cf" or 0xFE00 <= o <= 0xFE0F:
            to[ch] = ""
        elif kind == "Cc":
            to[ch] = ""
        else:
            how = unicodedata.decomposition(ch)
            radical = 0x2E80 <= o <= 0x2FDF and how.startswith("<compat>")
            numeral = 0x2160 <= o <= 0x217F and how.startswith("<compat>")
            ligature = 0xFB00 <= o <= 0xFB06 and how.startswith("<compat>")
            if how.startswith(("<wide>", "<narrow>", "<font>")) or radical or numeral or ligature:
                to[ch] = unicodedata.normalize("NFKD", ch)
    for o in (*range(0x20), 0x7F):
        if chr(o) not in "\t\n\v\f":
            to[chr(o)] = ""
    to |= dict.fromkeys(LINE_BREAKS, "\n") | SAME_SHAPE | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(NO_WIDTH, "")
    # a width form may decompose into a character that has a prototype itself
    for ch, into in list(to.items()):
        to[ch] = "".join(to.get(x, x) for x in into)
    ranges = "".join(re.escape(ch) for ch in sorted(to))
    return to, re.compile(f"[{ranges}]+")


def _pictograph(ch: str) -> bool:
    return "\U0001f000" <= ch <= "\U0001faff" or ch == "\ufe0f" or "\u2600" <= ch <= "\u27bf"


def skeleton(value: str | None) -> str | None:
    if value is None or value.isascii() and value.isprintable():
        return value
    to, replaced = _prototypes()
    text = unicodedata.normalize("NFD", value.replace("\r\n", "\n"))
    if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text):  # has characters beyond the basic plane, as all of these are
        text = _LETTERS.sub(lambda m: unicodedata.normalize("NFKD", m.group()), _TAGS.sub("", text))

    def swap(m: re.Match) -> str:
        run = m.group()
        out = "".join([to[ch] for ch in run])
        if _JOINER in run and m.start() and m.end() < len(text) and _pictograph(text[m.start() - 1]):
            if _pictograph(text[m.end()]):
                return out + _JOINER
        return out

    return unicodedata.normalize("NFD", replaced.sub(swap, text))


def consistent_form(value: str | None) -> str | None:
    """The skeleton in composed letters."""
    return None if value is None else unicodedata.normalize("NFC", skeleton(value))


def has_content(form: str | None) -> bool:
    return form is not None and not form.isspace() and form != ""


def comparable(value: str | None) -> str | None:
    """The consistent form in lower case, white space at the ends removed and inside as one blank."""
    return None if value is None else " ".join(consistent_form(value).lower().split())


@F.pandas_udf(T.StringType())
def consistent_form_udf(values: pd.Series) -> pd.Series:
    return values.map(consistent_form, na_action="ignore")


@F.pandas_udf(T.StringType())
def comparable_udf(values: pd.Series) -> pd.Series:
    return values.map(comparable, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def skeleton_key_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A 128-bit key of the skeleton, null for null and for values without content."""
    from hashlib import md5

    for part in values:
        yield pd.Series([md5(s.encode("utf-8", "surrogatepass")).digest() if has_content(s := skeleton(v)) else None for v in part], dtype=object)


def value_key(value: Column) -> Column:
    return F.unhex(F.md5(value.cast("binary")))


def look_keys(df: DataFrame, field: str, id_col: str, value_col: str) -> DataFrame:
    """(field, id, look, exact): keys of the skeleton and of the value as stored, for values with content."""
    return (
        df.select(F.lit(field).alias("field"), F.col(id_col).cast("bigint").alias("id"), skeleton_key_udf(value_col).alias("look"), value_key(F.col(value_col)).alias("exact"))
        .where("look IS NOT NULL")
    )


def same_look_pairs(keys: DataFrame) -> DataFrame:
    """All pairs of rows with the same skeleton and differing values.

    Only keys travel. Skeletons with one value as stored, however many rows share it, are dropped after a map-side
    combined count of values, so copies don't pair; the join meets the rest, and AQE splits a look that many rows share.
    """
    several = (
        keys.groupBy("field", "look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("field", "look")
    )
    rows = keys.join(several, ["field", "look"], "left_semi")
    a = rows.select("field", "look", F.col("id").alias("id_a"), F.col("exact").alias("exact_a"))
    b = rows.select("field", "look", F.col("id").alias("id_b"), F.col("exact").alias("exact_b"))
    return a.join(b, ["field", "look"]).where("id_a < id_b AND exact_a <> exact_b").select("field", "id_a", "id_b")


def look_classes(keys: DataFrame) -> DataFrame:
    """(field, id, class, n_values): every row with the least id of the rows that look the same and the number of differing
    values among these; as many rows as there are, however many copies a value has."""
    values = keys.groupBy("field", "look", "exact").agg(F.min("id").alias("id"))
    classes = values.groupBy("field", "look").agg(F.min("id").alias("class"), F.count("*").alias("n_values"))
    return keys.join(classes, ["field", "look"]).select("field", "id", "class", "n_values")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = look_keys(table(spark, sf_dir, "corpus_files"), "relpath", "file_id", "relpath")
    return files.unionByName(look_keys(table(spark, sf_dir, "extracted_pages"), "text", "page_id", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(materialize(_keys(spark, sf_dir)))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_classes(materialize(_keys(spark, sf_dir)))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relpath and project of every file in the consistent form."""
    return table(spark, sf_dir, "corpus_files").select(
        "file_id", consistent_form_udf("relpath").alias("relpath"), consistent_form_udf("project").alias("project")
    )


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page in the consistent form."""
    return table(spark, sf_dir, "extracted_pages").select("page_id", "doc_id", "no", consistent_form_udf("text").alias("text"))


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms, "p4_texts": p4_texts}
ORACLES: dict[str, str] = {}
