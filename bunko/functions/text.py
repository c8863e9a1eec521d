"""Scalar text functions as column expressions; Python only where Spark has no built-in (Unicode normalization)."""

from __future__ import annotations

import fnmatch
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_NUMBER = r"-?\d+(?:\.\d+)?"
# Width forms of ASCII.
_WIDE, _NARROW = "".join(chr(0xFEE0 + o) for o in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F)))
# The marks of formatted text, in the order in which they are taken off, and what stays of each.
_MARKS = [
    (r"(?s)\[c:[0-9A-Fa-f]{6}\](.*?)\[/c\]", "$1"),
    (r"\[/c\]", ""),
    (r"(?s)==(.*?)==\{[^}]*\}", "$1"),
    (r"\{(?:shape-)?fill:[^}]*\}", ""),
    (r"(?s)\{fml:(.*?)\}", "$1"),
    (r"</?u>", ""),
    (r"(?s)\*\*(.+?)\*\*", "$1"),
    (r"(?s)~~(.+?)~~", "$1"),
    (r"(?<!\*)\*(?!\*)([^*\n]+?)(?<!\*)\*(?!\*)", "$1"),
    (r"[ \t]{2,}", " "),
]
# Scripts written without blanks between words.
_RUN = r"\u3041-\u3096\u30A1-\u30FAー\u4E00-\u9FA5\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
# All of it lies from U+2E80 on: a comparison spares most signs the look-up of their script.
_RUN_SIGN = rf"[\u2E80-\x{{10FFFF}}&&[{_RUN}]]"
_WORD_SIGN = rf"[[\x00-\u2E7F&&[\p{{L}}\p{{N}}]][\u2E80-\x{{10FFFF}}&&[^{_RUN}]&&[\p{{L}}\p{{N}}]]]"


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def _thousands(text: Column) -> Column:
    """Without the commas that stand before exactly three digits."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")


def normalize_answer(text: Column) -> Column:
    """Form in which answers are compared: compatibility form, ASCII punctuation, no thousands separators, no white space,
    lower case. Commas go before white space, so the function isn't idempotent."""
    out = F.translate(F.trim(nfkc(text)), "：，、．％（）〜－―ー", ":,,.%()~---")
    return F.lower(F.regexp_replace(_thousands(out), r"[\s\u3000]+", ""))


def numbers(text: Column) -> Column:
    """All signed decimals of a text, in order; width forms count, thousands separators don't."""
    found = F.regexp_extract_all(_thousands(nfkc(text)), F.lit(_NUMBER), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))


def elements(text: Column) -> Column:
    """Parts of an enumeration."""
    return F.filter(F.transform(F.split(text, "[、,]"), lambda x: F.trim(x)), lambda x: x != "")


def same_answer(a: Column, b: Column) -> Column:
    """Equal in normal form, or the same numbers in the same order and what is left of one within the other. Null is
    taken as empty."""
    x, y = (F.coalesce(normalize_answer(c), F.lit("")) for c in (a, b))
    m, n = (F.coalesce(numbers(c), F.array().cast("array<double>")) for c in (a, b))
    u, v = (F.regexp_replace(c, _NUMBER, "") for c in (x, y))
    return (x == y) | ((x != "") & (y != "") & (F.size(m) > 0) & (m == n) & (u.contains(v) | v.contains(u)))


def same_elements(a: Column, b: Column) -> Column:
    """The same set of parts, and not none."""
    x, y = (F.array_sort(F.array_distinct(F.transform(elements(c), _plain))) for c in (a, b))
    return F.coalesce((F.size(x) > 0) & (x == y), F.lit(False))


def _plain(part: Column) -> Column:
    out = F.translate(part, _WIDE + "：，、．％（）〜－―ー", _NARROW + ":,,.%()~---")
    return F.lower(F.regexp_replace(_thousands(out), r"[\s\u3000]+", ""))


def one_line(text: Column) -> Column:
    """An answer as one line: without tags of tools and thoughts and fences, white space squeezed, quotes at the ends off."""
    out = F.regexp_replace(text, r"(?i)</?(?:answer|invoke|parameter|function[^>]*|tool[^>]*)>|<\s*/?\s*thought[^>]*>?", "")
    out = F.regexp_replace(F.trim(out), r"^```[a-zA-Z]*\s*|\s*```$", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[\r\n\t]+", " "), " {2,}", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r'^"+|"+$', ""), "^[「」]+|[「」]+$", ""))


def token_estimate(text: Column) -> Column:
    """A rough number of tokens: half the characters."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 2)


def strip_markup(text: Column) -> Column:
    """Remove colour, highlight and fill marks, underline, bold, strike and italic; a formula mark leaves its formula;
    blanks are squeezed."""
    out = text
    for pattern, kept in _MARKS:
        out = F.regexp_replace(out, pattern, kept)
    return out


def styled(text: Column, strike: Column, underline: Column, italic: Column, bold: Column, highlight: Column, colour: Column) -> Column:
    """A run of text in the marks of its style, from the innermost: strike, underline, italic, bold, the name of a
    highlight, a colour RRGGBB. White space at the ends stays outside; a blank text has no marks. Null style is none."""
    blank = r"[\s\u3000\u00a0]"
    part = lambda i: F.regexp_extract(text, f"(?s)^({blank}*)(.*?)({blank}*)$", i)
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    marked = lambda on, mark: lambda t: F.when(on, mark(t)).otherwise(t)
    marks = [
        (strike, lambda t: F.concat(F.lit("~~"), t, F.lit("~~"))),
        (underline, lambda t: F.concat(F.lit("<u>"), t, F.lit("</u>"))),
        (italic, lambda t: F.concat(F.lit("*"), t, F.lit("*"))),
        (bold, lambda t: F.concat(F.lit("**"), t, F.lit("**"))),
        (named(highlight), lambda t: F.concat(F.lit("=="), t, F.lit("=={"), highlight, F.lit("}"))),
        (named(colour), lambda t: F.concat(F.lit("[c:"), colour, F.lit("]"), t, F.lit("[/c]"))),
    ]
    # each mark is a step over a value of its own, so that expressions stay small
    core = F.array(part(2))
    for on, mark in marks:
        core = F.transform(core, marked(on, mark))
    return F.when(part(2) == "", text).otherwise(F.concat(part(1), F.get(core, F.lit(0)), part(3)))


def clip(text: Column, n: int) -> Column:
    """White space squeezed; longer texts are cut to n characters that end in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def middle_out(text: Column, limit: int, tail_share: float = 0.35) -> Column:
    """Keep head and tail of a text above the limit, with a note of what was left out between them."""
    tail = int(limit * tail_share)
    note = F.concat(F.lit("\n... ["), (F.length(text) - limit).cast("string"), F.lit(" characters left out] ...\n"))
    cut = F.concat(F.substring(text, 1, limit - tail), note, F.right(text, F.lit(tail)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def version_key(path: Column) -> Column:
    """Path without archive folders and with version tokens removed from the name, to group versions of a file."""
    parts = F.split(path, "/")
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: ~F.lower(d).isin("old", "旧", "archive", "_old", "backup"))
    name = F.element_at(parts, -1)
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(stem, r"(?i)_pw-[^_]*", "")
    stem = F.regexp_replace(stem, r"(?i)[_\-\s(（]*(?:v(?:er)?\.?\s*\d+(?:\.\d+)*|rev\.?\d+|final|draft|old|copy|最終版?|確定版?|修正版?|改訂版?|旧版?|コピー)[)）]*", "")
    return F.concat_ws("/", folders, F.concat(F.regexp_replace(stem, r"^[_\-\s]+|[_\-\s]+$", ""), ext))


def tokens(text: Column) -> Column:
    """Search terms in lower case: words of letters and digits; of runs of ideographs and kana every two neighbours, or
    the one there is; then once more every ASCII term of two or more characters, with its dots, dashes and underscores."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(f"({_WORD_SIGN}+)"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"({_RUN_SIGN}+)"), F.lit(1))
    two = F.regexp_extract_all(F.concat_ws(" ", runs), F.lit(f"(?=({_RUN_SIGN}{{2}}))"), F.lit(1))
    one = F.filter(runs, lambda x: F.length(x) == 1)
    ascii_terms = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_.\-]{2,})"), F.lit(1)), F.lower)
    return F.concat(words, two, one, ascii_terms)


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell pattern whose * and ? cross folders."""
    return f"(?s)^{fnmatch.translate(glob)}$"


def safe_name(value: Column, fallback: str = "item") -> Column:
    """A name that every file system takes: composed, no reserved characters or names, no dots and blanks at its end, at
    most 120 characters."""
    out = F.regexp_replace(F.regexp_replace(F.trim(nfc(F.coalesce(value, F.lit("")))), r'[<>:"/\\|?*\x00-\x1f]', "_"), "[. ]+$", "")
    out = F.when(out == "", F.lit(fallback)).otherwise(out)
    return F.substring(F.when(F.upper(out).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), out)).otherwise(out), 1, 120)


def colour_name(hex6: Column) -> Column:
    """Name of a colour RRGGBB by hue, saturation and value; empty for white."""
    part = lambda at: F.conv(F.substring(hex6, at, 2), 16, 10).cast("double") / 255
    # each step is a value of its own, so that expressions stay small
    rgb = F.array(F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))
    span = F.transform(rgb, lambda x: F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"), F.greatest(x["r"], x["g"], x["b"]).alias("hi"), F.least(x["r"], x["g"], x["b"]).alias("lo")))
    hsv = F.transform(span, lambda x: F.struct(_hue(x).alias("hue"), F.coalesce((x["hi"] - x["lo"]) / F.nullif(x["hi"], F.lit(0.0)), F.lit(0.0)).alias("sat"), x["hi"].alias("hi")))
    return F.get(F.transform(hsv, _colour), F.lit(0))


def _hue(x: Column) -> Column:
    r, g, b, hi = x["r"], x["g"], x["b"], x["hi"]
    span = F.nullif(hi - x["lo"], F.lit(0.0))
    hue = F.when(hi == r, (g - b) / span + F.when(g < b, 6).otherwise(0)).when(hi == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span) * 60
    return F.coalesce(hue, F.lit(0.0))


def _colour(x: Column) -> Column:
    hue, sat, hi = x["hue"], x["sat"], x["hi"]
    # fixed values: names and limits of hues
    base = F.when((hue < 15) | (hue >= 345), "赤").when(hue < 48, F.when((sat > 0.5) & (hi < 0.6), "茶").otherwise("オレンジ")).when(hue < 68, "黄").when(hue < 165, "緑").when(hue < 210, "水色").when(hue < 255, "青").when(hue < 290, "紫").otherwise("ピンク")
    grey = F.when(hi > 0.92, "").when(hi < 0.25, "黒").otherwise("グレー")
    tone = F.when(hi < 0.35, "濃").when((sat < 0.3) & (hi > 0.85), "薄").otherwise("")
    return F.when(sat < 0.06, grey).otherwise(F.concat(tone, base))


def markdown_row(cells: Column) -> Column:
    clean = F.transform(cells, lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """A table of rows of cells: short rows are padded, the first is the header; empty for no cells."""
    width = F.array_max(F.transform(rows, F.size))
    full = F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    lines = F.transform(full, markdown_row)
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")
    return F.when(F.coalesce(width, F.lit(0)) == 0, "").otherwise(table)


def floor_quantile(values: Column, q: float) -> Column:
    """The element of the sorted values at the rank (n - 1) * q, rounded down; 0 for none."""
    at = F.floor((F.size(values) - 1) * q).cast("int")
    return F.when(F.size(values) == 0, 0).otherwise(F.get(F.array_sort(values), at))


def region(text: Column) -> Column:
    """The rectangle x0,y0,x1,y1 within 0 to 1, or null."""
    at = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    x = lambda i: F.get(at, F.lit(i))
    ok = (F.size(at) == 4) & (x(0) >= 0) & (x(1) >= 0) & (x(2) <= 1) & (x(3) <= 1) & (x(0) < x(2)) & (x(1) < x(3))
    return F.when(ok, F.struct(x(0).alias("x0"), x(1).alias("y0"), x(2).alias("x1"), x(3).alias("y1")))
