"""Bounds of training samples, and SQL over short test items."""

import duckdb
import pytest
from pyspark.sql import functions as F

from termloom.llm import op_decontam, op_langid, queries


@pytest.mark.parametrize("texts", ["different", "equal"])
def test_language_sample_is_bounded_under_one_id(spark, monkeypatch, texts):
    """A third of all rows under one doc_id, or all with one text too, take no more than the sample."""
    seen = []
    n = 6000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(4)).otherwise(F.col("id") * 4).alias("doc_id"),
        F.concat(F.lit("some words of text "), F.when((F.col("id") % 3 == 0) & F.lit(texts == "equal"), F.lit("same")).otherwise(F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))

    frame = type(rows)
    original = frame.mapInArrow

    def spy(self, func, schema, *a, **k):
        seen.append(self.count())
        return original(self, func, schema, *a, **k)

    monkeypatch.setattr(frame, "mapInArrow", spy)
    op_langid.train(rows, sample=300)
    assert seen and 200 < seen[0] < 400 if texts == "different" else seen[0] < 400


def test_short_items_in_sql(spark, tmp_path):
    """Items of 8 to 12 tokens and more, substituted and cut off: the operator's rows are those of all alignments."""
    words = [f"w{i}" for i in range(60)]
    items = [(n, " ".join(words[n : n + n])) for n in range(7, 15)]
    docs = []
    for n, text in items:
        w = text.split()
        docs.append(" ".join(["a", "b", *w, "c"]))
        docs.append(" ".join(["a", *w[:2], "x", *w[3:], "z"]))
        docs.append(" ".join(["a", *w[:2], "x", *w[3:5], "y", *w[6:], "z"]))
        docs.append(" ".join(w[1:]))
        docs.append(" ".join(w[2:] + ["end"]))
    spark.createDataFrame(list(enumerate(docs)) + [(99, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items + [(50, None)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT doc_id, item_id, shift, n_equal FROM ({queries.OP6_SQL})").fetchall())
    found = op_decontam.contaminated(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "benchmark")))
    got = sorted((r["doc_id"], r["item_id"], r["shift"], r["n_equal"]) for r in found.collect())
    assert got == want and {i for _, i, *_ in got} >= {8, 9, 10, 11, 12, 13, 14}
