"""Quiz questions: length bands, scopes, options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.operators.ranking import numbered_values

EASY_BELOW = 120


def in_band(terms: DataFrame, band: str) -> DataFrame:
    """easy: definitions under 120 characters; hard: the others; all."""
    n = F.length("definition")
    return {"easy": terms.filter(n < EASY_BELOW), "hard": terms.filter(n >= EASY_BELOW), "all": terms}[band]


def in_scope(terms: DataFrame, scope: DataFrame) -> DataFrame:
    return terms.join(scope.select("slug").distinct(), "slug", "left_semi")


def questions(terms: DataFrame, n: int, seed: int) -> DataFrame:
    """A reproducible random choice of ``n`` terms, or all there are, with ``place`` 1..: their
    order by a seeded md5."""
    drawn = terms.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "slug").cast("binary"))).orderBy("_h", "slug").limit(n)
    return drawn.withColumn("place", F.row_number().over(W.orderBy("_h", "slug"))).drop("_h")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows in a reproducible random order, ``place`` 0..: that of a seeded md5 of their key, equal keys together.

    The first digits of the md5 are cells that are sorted apart (``numbered_values``), so no task holds all rows."""
    marked = rows.withColumn("_v", F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return marked.join(numbered_values(marked, "_v"), "_v").drop("_v")


def distractors(asked: DataFrame, options: DataFrame, seed: int, k: int = 3) -> DataFrame:
    """``(slug, option, place)``: ``k`` different wrong options for each question (``slug, answer``), or
    as many as there are.

    All different ``options (option)`` are numbered in a shuffled order and cut into
    ``k + 1`` stretches; each question draws one number from every stretch by a hash of its own
    and leaves out its answer, or else the last.  Questions meet options on the number, so no
    question sees more than ``k + 1`` of them however many there are.
    """
    every = numbered_values(options, "option", "number")
    total = every.agg(F.count("*").alias("m")).withColumn("_one", F.lit(1))
    asked = asked.select("slug", "answer").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
    drawn = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    low, high = F.floor(F.col("i") * F.col("m") / (k + 1)), F.floor((F.col("i") + 1) * F.col("m") / (k + 1))
    h = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), "slug", "i").cast("binary")), F.lit(12)), 16, 10).cast("long")
    drawn = drawn.filter(high > low).select("slug", "answer", "i", (low + h % (high - low)).alias("number"))
    wrong = drawn.join(every, "number").filter("option <> answer")
    by = W.partitionBy("slug").orderBy("i")
    return wrong.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).select("slug", "option", "place")
