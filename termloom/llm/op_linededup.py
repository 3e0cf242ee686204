"""Line dedup over windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import P

WIDTH = 3


def _windows(docs: DataFrame) -> DataFrame:
    """``(doc, pos, h1, h2)``: a 128-bit hash of each window of three lines.

    Windows with nothing but spaces do not count.  ``doc`` is (doc_id, hash of the
    text): rows that repeat both are one document listed twice.
    """
    lines = docs.select(_doc().alias("doc"), F.split("text", "\n").alias("l")).filter(F.size("l") >= WIDTH)
    n = F.size("l") - (WIDTH - 1)
    rows = F.arrays_zip(*[F.slice("l", i + 1, n).alias(f"l{i}") for i in range(WIDTH)])
    parts = [F.col(f"w.l{i}") for i in range(WIDTH)]
    return (
        lines.select("doc", F.posexplode(rows).alias("pos", "w"))
        .filter(F.trim(F.concat(*parts)) != "")
        .select("doc", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(WIDTH), *parts).alias("h2"))
    )


def _doc() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc, starts)``: per document the sorted starts of windows seen earlier.

    Earlier means an earlier (doc_id, position); the first occurrence of every
    window anywhere stays.  The search pre-aggregates per task, so a window that
    is in a third of all documents reaches the shuffle once per task; marking
    its later occurrences is an ordinary join that adaptive execution splits.
    """
    w = _windows(docs)
    first = (
        w.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first"))
        .filter("n > 1")
        .select("h1", "h2", "first")
    )
    later = w.join(first, ["h1", "h2"]).filter(F.struct("doc", "pos") > F.col("first"))
    return later.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """All input columns with ``text`` reduced, plus the reserved columns
    ``__llm_n_lines``, ``__llm_n_removed``.

    Every line covered by a repeated window (overlaps merged) goes.  Lines are
    split at line feeds and compared exactly.  Null text stays null with 0
    lines; empty text is one empty line; documents under three lines keep all.
    A text all of whose lines go becomes empty.  Windows of blank lines never
    count.  Null doc_ids sort first.  Other columns pass through untouched; an
    empty table stays empty.
    """
    own = docs.withColumn(f"{P}doc", F.struct(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th")))
    found = repeated_windows(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")))
    found = found.select(F.col("doc").alias(f"{P}doc"), F.col("starts").alias(f"{P}starts"))
    lines = F.col(f"{P}lines")
    starts = F.col(f"{P}starts")
    # Kept lines lie between the end of one covered run and the next start.
    ends = F.concat(F.array(F.lit(0)), F.transform(starts, lambda p: p + WIDTH))
    nexts = F.concat(starts, F.array(F.size(lines)))
    kept = F.flatten(F.transform(
        F.arrays_zip(ends.alias("a"), nexts.alias("b")),
        lambda g: F.slice(lines, g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0)))))
    marked = own.join(found, f"{P}doc", "left").withColumn(f"{P}lines", F.split("text", "\n"))
    marked = marked.withColumn(f"{P}kept", F.when(starts.isNull(), lines).otherwise(kept))
    n_lines = F.coalesce(F.when(lines.isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    n_kept = F.coalesce(F.when(lines.isNotNull(), F.size(f"{P}kept")), F.lit(0)).cast("long")
    return marked.select(
        *[F.when(starts.isNull(), F.col("text")).otherwise(F.array_join(f"{P}kept", "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n_lines.alias(f"{P}n_lines"),
        (n_lines - n_kept).alias(f"{P}n_removed"),
    )
