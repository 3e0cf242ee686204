"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, durable, hash_fraction, held_out, texts
from termloom.llm.ngrams import chunks, letters

SIZES, BITS = (3, 4, 5, 6), 20
#: Training texts, at most about so many (a reproducible random sample of the labelled rows).
SAMPLE = 12_000
#: n-grams kept: those whose log-count ratio stands out most against its own error.
FEATURES = 4096
SMOOTH = 0.5
#: An n-gram that fewer training texts hold is no feature: its ratio says nothing yet.
LEAST = 3


@dataclass
class ToxicityModel:
    slot: np.ndarray  # bucket -> feature, or -1
    weight: np.ndarray  # feature -> log-count ratio times learned weight
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[present(text, self.slot)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def buckets_of(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's n-grams."""
    seen = [np.empty(0, np.int64), *map(np.unique, chunks(letters(text), SIZES, BITS))]
    return np.unique(np.concatenate(seen))


def present(text: str | None, slot: np.ndarray) -> np.ndarray:
    """The features that a text has, each once."""
    seen = [np.empty(0, slot.dtype)]
    for h in chunks(letters(text), SIZES, BITS):
        f = slot[h]
        seen.append(np.unique(f[f >= 0]))
    return np.unique(np.concatenate(seen))


def _examples(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(toxic, text)`` of a bounded sample of the labelled documents outside the fold.

    A document with several labels counts as toxic if any says so; of several texts under one
    doc_id that of the least hash counts, so that ``sample`` bounds rows too.
    """
    named = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, sample / max(1, named.count()))
    chosen = named.filter(hash_fraction(F.col("doc_id")) < share)
    # A few thousand ids and labels: bounded by ``sample``, so this side is sent to all.
    found = texts(docs).filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on labelled rows outside the evaluation fold.

    Spark counts in how many toxic and other texts each n-gram bucket occurs and
    keeps the ``FEATURES`` that stand out; each text then comes down to its few
    kept features.  The logistic fit on these (bounded by ``sample``) runs on the
    driver.  With labels of one kind only, or none, every score is 1 or 0 by kind,
    or 0.
    """
    # A few thousand texts at most, read three times below: written once.
    chosen = durable(_examples(docs, labels, sample))

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[int(toxic > 0), buckets_of(text)] += 1
        at = np.flatnonzero(sums.sum(axis=0) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[1, at]), pa.array(sums[0, at])], ["bucket", "pos", "neg"])

    n = chosen.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("pos"), F.count("*").alias("all")).first()
    pos, neg = n["pos"] or 0, n["all"] - (n["pos"] or 0)
    slot = np.full(1 << BITS, -1, np.int32)
    if not pos or not neg:
        discard(chosen)
        return ToxicityModel(slot, np.zeros(1), 30.0 if pos else -30.0)
    p = (F.col("pos") + SMOOTH) / (pos + 2 * SMOOTH)
    q = (F.col("neg") + SMOOTH) / (neg + 2 * SMOOTH)
    ratio = F.log(p / q)
    error = F.sqrt(1 / (F.col("pos") + SMOOTH) + 1 / (F.col("neg") + SMOOTH))
    kept = (
        chosen.mapInArrow(count, "bucket int, pos long, neg long")
        .groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(F.col("pos") + F.col("neg") >= LEAST)
        # At most 2**BITS rows are left; few partitions, as each sends its best to the driver.
        .repartition(8)
        .select("bucket", ratio.alias("ratio"), (F.abs(ratio) / error).alias("stands_out"))
        .orderBy(F.desc("stands_out"), "bucket").limit(FEATURES).toPandas()
    )
    slot[kept["bucket"].to_numpy(int)] = np.arange(len(kept))
    ratios = kept["ratio"].to_numpy(float)

    def reduce(batches):
        for b in batches:
            rows = [present(t, slot) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "features"])

    rows = chosen.mapInArrow(reduce, "toxic int, features array<int>").toPandas()
    # Rows arrive in any order; the fit below sums over all of them.
    discard(chosen)
    y = (rows["toxic"].to_numpy() > 0).astype(float)
    lens = rows["features"].map(len).to_numpy()
    doc, feat = np.repeat(np.arange(len(rows)), lens), np.concatenate([np.empty(0, np.int32), *rows["features"]]).astype(int)
    weight, bias = _fit(doc, feat, ratios, y)
    return ToxicityModel(slot, ratios * weight if len(ratios) else np.zeros(1), bias)


def _fit(doc: np.ndarray, feat: np.ndarray, ratios: np.ndarray, y: np.ndarray, steps: int = 400, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features by Adam over all rows at once."""
    n, k, x = len(y), len(ratios), ratios[feat]
    w = np.zeros(k + 1)
    rate = y.mean()
    w[k] = np.log(rate / (1 - rate))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = w[k] + np.bincount(doc, x * w[feat], n)
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(feat, x * g[doc], k) / n + l2 * w[:k], g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:k], float(w[k])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row, whole texts.

    Null and empty texts have no feature and get the score of the bias alone.
    Rows that repeat a doc_id and null doc_ids are kept; extra columns are
    ignored; an empty table gives no rows.
    """
    # Bounded: 4 bytes for each of 2**BITS buckets.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            s = np.array([m.score(t) for t in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
