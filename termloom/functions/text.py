"""Column functions over words, tokens and markup."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What words of the matcher are made of: Hangul syllables, Latin letters and hyphens.
LETTERS = "가-힣A-Za-z-"
WORD = f"[{LETTERS}]+"

# The particles that attach to a Korean noun, in order of trial.
PARTICLES = (
    "에서", "으로", "부터", "까지", "이나", "이랑",
    "은", "는", "이", "가", "을", "를", "의", "에", "로", "와", "과", "도", "만", "나", "랑",
)


def normalize_word(word: Column) -> Column:
    """Lower case, without hyphens, underscores and white space."""
    return F.translate(F.lower(word), "-_ \t\n\x0b\f\r", "")


def word_occurrences(text: Column, letters: str = LETTERS) -> Column:
    """``array<struct<word, start>>`` in order; starts count code points from 0.

    Spark's own functions give the words but not where they stand, and adding up
    the lengths of words and gaps costs several passes; here it is one, in Arrow batches.
    """
    find = re.compile(f"[{letters}]+").finditer

    @F.arrow_udf("array<struct<word:string,start:int>>")
    def occurrences(batch: pa.Array) -> pa.Array:
        words, starts, ends = [], [], [0]
        for t in batch.to_pylist():
            for m in find(t or ""):
                words.append(m[0])
                starts.append(m.start())
            ends.append(len(words))
        each = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(starts, pa.int32())], ["word", "start"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return occurrences(text)


def candidate_forms(form: Column) -> Column:
    """``array<struct<form, cut>>`` of a normalised word: itself, then it without each
    particle it ends in; ``cut`` is the particle's length."""
    forms = [F.struct(form.alias("form"), F.lit(0).alias("cut"))]
    # A word ends in one particle of each length at most; the longer ones come first in the list.
    for n in sorted({len(p) for p in PARTICLES}, reverse=True):
        ending = F.right(form, F.lit(n)).isin(*[p for p in PARTICLES if len(p) == n]) & (F.length(form) > n)
        forms.append(F.when(ending, F.struct(F.left(form, F.length(form) - n).alias("form"), F.lit(n).alias("cut"))))
    return F.array_compact(F.array(*forms))


def similarity_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and Hangul syllables, two characters or longer."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9가-힣]+", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda t: F.length(t) >= 2)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no such function."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def spelling_key(text: Column) -> Column:
    """What spellings of one term share: NFKC, without spaces, dots, dashes and brackets, lower case."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"[\s·・\-–—_/()\[\]{},.]+", ""))


def escape_html(text: Column, apostrophe: str | None = "&#39;") -> Column:
    """Entities for & < > and quotes; ``apostrophe`` None leaves apostrophes alone."""
    steps = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")] + ([("'", apostrophe)] if apostrophe else [])
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_xml(text: Column) -> Column:
    return escape_html(text, "&apos;")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def sanitize_input(text: Column) -> Column:
    """Trimmed, without NULs and script-carrying URL schemes; null becomes empty."""
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)\x00|javascript:|vbscript:|data:text/html", "")


# What marks an input as an attempt at script injection.
XSS_MARKS = ("<script", "</script>", "javascript:", "onerror=", "onclick=", "onload=", "iframe", r"document\.cookie", r"window\.location")


def detect_xss(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(XSS_MARKS)), F.lit(False))


def detect_spam(text: Column) -> Column:
    """A character ten times in a row, or over five words of which under half differ."""
    words = F.split(text, " ")
    repeated = (F.size(words) > 5) & (F.size(F.array_distinct(words)) < F.size(words) / 2)
    return F.coalesce(text.rlike(r"(.)\1{9,}") | repeated, F.lit(False))


def limit_length(text: Column, most: int = 10_000) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(most))


def valid_email(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def validate_user_input(text: Column) -> Column:
    """``struct<safe, reason, value>``: the cleaned, escaped value, or why it is refused."""
    clean = limit_length(sanitize_input(text))
    reason = F.when(detect_xss(clean), "xss").when(detect_spam(clean), "spam")
    return F.struct(
        reason.isNull().alias("safe"),
        reason.alias("reason"),
        F.when(reason.isNull(), escape_html(clean, "&#039;")).alias("value"),
    )


def slug_of(path: Column) -> Column:
    """The last part of a path without its .htm(l) ending."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.html?$", "")


def url_component(text: Column) -> Column:
    """Percent-encoding with spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def excerpt(text: Column, most: int = 40) -> Column:
    return F.concat(F.left(F.trim(text), F.lit(most)), F.lit("..."))


def document_hash(content: Column, name: Column | None = None, size: Column | None = None) -> Column:
    """The content's SHA-256; of a file that could not be read (null), its ``name:size``."""
    if name is None or size is None:
        return F.sha2(content, 256)
    return F.coalesce(F.sha2(content, 256), F.concat_ws(":", name, size.cast("string")))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def date_only(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def utc_string(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def korean_timestamp(ts: Column) -> Column:
    """The long Korean form: year, month and day, then the twelve-hour time with its half of the day in front."""
    half = F.when(F.hour(ts) < 12, F.lit("오전")).otherwise(F.lit("오후"))
    return F.concat_ws(" ", F.date_format(ts, "yyyy년 M월 d일"), half, F.date_format(ts, "hh:mm"))


def day_seed(ts: Column) -> Column:
    return F.concat_ws("-", F.year(ts), F.month(ts), F.dayofmonth(ts))
