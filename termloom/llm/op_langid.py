"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a binary n-gram classifier
tells the languages with that bit set from the others.  A text is given the
language whose codeword loses least against the classifiers' margins.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import P, hash_fraction, held_out, texts
from termloom.llm.ngrams import chunks, letters

SIZES, BITS = (1, 2, 3, 4), 15
#: Training texts per language, at most about so many (a reproducible random sample).
SAMPLE = 3000
#: Nearer to the next language than this, a decision counts as ambiguous.
MARGIN = 0.2
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all useful splits for up to 5 classes, else about
    10 log2 k random columns, the best spread of 50 draws."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        cols = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 2 ** (k - 1))]
        return np.array(cols, float).T
    rng, n, best, far = random.Random(k), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(50):
        m = np.array([[rng.choice((-1, 1)) for _ in range(n)] for _ in range(k)], float)
        m = m[:, np.abs(m.sum(axis=0)) < k]
        d = min(((m[i] != m[j]).sum() for i in range(k) for j in range(i)), default=0)
        if d > far:
            best, far = m, d
    return best


def counts_of(text: str | None) -> np.ndarray:
    return sum((np.bincount(idx, minlength=1 << BITS) for idx in chunks(letters(text), SIZES, BITS)), np.zeros(1 << BITS, np.int64))


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: mean margin contributions
    scale: np.ndarray  # per bit: margins divided by this are about +-1 on training data
    weight_of_bit: np.ndarray  # from each bit classifier's accuracy

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in [0, 1], whether it is ambiguous."""
        if not text or not _LETTER(text) or not self.languages:
            return UNKNOWN, 0.0, True
        b = letters(text)
        total, n = np.zeros(self.weights.shape[1]), 0
        for idx in chunks(b, SIZES, BITS):
            c = np.bincount(idx, minlength=1 << BITS)
            used = np.flatnonzero(c)
            total += c[used] @ self.weights[used]
            n += len(idx)
        margin = total / max(n, 1) / self.scale
        loss = np.logaddexp(0, -2 * self.codes * margin) @ self.weight_of_bit
        order = np.argsort(loss, kind="stable")
        p = np.exp(-3 * (loss - loss[order[0]]))
        best = float(p[order[0]] / p.sum())
        close = len(order) > 1 and float(loss[order[1]] - loss[order[0]]) < MARGIN
        return self.languages[order[0]], best, close


def train(docs: DataFrame, sample: int = SAMPLE, lang_col: str = "lang") -> LanguageModel:
    """Fit on rows outside the evaluation fold with a language.

    The n-grams of at most about ``sample`` different texts per language are counted by Spark; only
    the sums, one vector per language, reach the driver.
    """
    rows = texts(docs).withColumn("lang", F.lit(None)) if lang_col not in docs.columns else docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # One row a language; the texts are not read for it.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = rows.filter(F.col("text").isNotNull())
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.zeros((1 << BITS, 1)), np.ones(1), np.ones(1))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])
    # Drawn by id and text, each different text once: however many rows repeat an id or a text, the bound holds.
    chosen = rows.filter(hash_fraction(F.col("doc_id"), F.col("text")) < F.try_element_at(share, F.col("lang"))).select("lang", "text").distinct()

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # Each text counts alike, long or short.
                c = counts_of(text)
                sums[lang] = sums.get(lang, 0) + np.sqrt(c) / max(1.0, np.sqrt(c.sum()))
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "bucket", "v"])

    partial = chosen.mapInArrow(count, "lang string, bucket int, v double")
    total = partial.groupBy("lang", "bucket").agg(F.sum("v").alias("v")).toPandas()
    share_of = np.zeros((len(languages), 1 << BITS))
    where = {k: i for i, k in enumerate(languages)}
    share_of[total["lang"].map(where).to_numpy(int), total["bucket"].to_numpy(int)] = total["v"].to_numpy(float)
    share_of = (share_of + 0.01) / (share_of + 0.01).sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.zeros((1 << BITS, codes.shape[1]))
    scale, sure = np.ones(codes.shape[1]), np.ones(codes.shape[1])
    for j in range(codes.shape[1]):
        one, rest = share_of[codes[:, j] > 0], share_of[codes[:, j] < 0]
        if len(one) and len(rest):
            weights[:, j] = np.clip(np.log(one.mean(axis=0) / rest.mean(axis=0)), -4, 4)
            m = share_of @ weights[:, j]
            cut = (m[codes[:, j] > 0].min() + m[codes[:, j] < 0].max()) / 2
            weights[:, j] -= cut
            scale[j] = max(np.abs(m - cut).mean(), 1e-6)
            sure[j] = max((m[codes[:, j] > 0].min() - m[codes[:, j] < 0].max()) / scale[j], 0.05)
    return LanguageModel(languages, codes, weights.astype(np.float32).astype(float), scale, sure / sure.sum() * len(sure))


def classify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row, whole texts.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text where no language was learned.  Rows that repeat a doc_id and null
    doc_ids are kept; extra columns are ignored; an empty table gives no rows.
    Two languages that lose alike: the first in order of name.
    """
    # The model is bounded: 2**15 buckets by the bits of the codewords.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            out = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows, all columns, whose text is in some learned language: ``und`` goes.

    An ambiguous text stays, since it is in one language or another.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    known = F.arrow_udf(lambda s: pa.array([sent.value.predict(t)[0] != UNKNOWN for t in s.to_pylist()], pa.bool_()), "boolean")
    return docs.withColumn(f"{P}known", known(F.col("text").cast("string"))).filter(f"{P}known").drop(f"{P}known")
