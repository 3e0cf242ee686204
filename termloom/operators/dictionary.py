"""The dictionary side of matching: keys under which terms are found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import PARTICLES, normalize_word

# Titles that are everyday words, so that a match says nothing.
AMBIGUOUS_TITLES = (
    "단가", "보존", "등록", "복원", "열화", "환수", "후원", "유증", "응답",
    "요약", "접수", "소진", "점검", "균형", "대처", "자문", "환기", "경계",
    "직면", "강도", "배경", "시점", "단계", "갱신", "해결", "왜곡",
    "요소", "사료", "타자", "전사", "번역", "실속", "교차", "직시", "철창", "불안",
    "구분", "검증", "과실", "인수", "재발", "채권",
    "가구", "대조", "도식", "동화", "조절", "의지", "보장", "안정제", "구축",
    "산출", "성과", "적절성", "교란", "이력", "피로", "코어", "밀봉",
    "완화", "대비", "대응", "신속성", "강건성", "알선", "링크", "렌치",
)

#: Tables up to so many bytes are sent to every task; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def title_keys(terms: DataFrame) -> DataFrame:
    """``(key, slug, term_ord)``: each term under its normalised Korean and English titles.

    Keys under two characters and bare particles are left out, as are Korean
    titles that are everyday words.  A slug is under a key once, at its first place.
    """
    ko = F.when(~F.col("title_ko").isin(*AMBIGUOUS_TITLES), F.col("title_ko"))
    keys = terms.select("slug", "term_ord", F.explode(F.array(normalize_word(ko), normalize_word(F.col("title_en")))).alias("key"))
    usable = keys.filter((F.length("key") >= 2) & ~F.col("key").isin(*PARTICLES))
    return usable.groupBy("key", "slug").agg(F.min("term_ord").alias("term_ord"))


def alias_keys(terms: DataFrame) -> DataFrame:
    """``(key, slug)``: each term under its lower-cased English title and aliases."""
    names = F.array_compact(F.concat(F.array("title_en"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return terms.select("slug", F.explode(F.transform(names, F.lower)).alias("key")).filter("key <> ''").distinct().select("key", "slug")


def sent_to_all(rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with a broadcast hint if their measured size allows it.

    The size counts the characters of every column twice, plus 32 bytes a value, which is above
    what a broadcast row takes.  ``rows`` should be cheap to compute, or kept: it is computed once
    for the measure and once for the join.
    """
    width = sum((F.coalesce(2 * F.length(F.col(c).cast("string")), F.lit(0)) + 32 for c in rows.columns), F.lit(0))
    size = rows.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(rows) if size <= limit else rows
