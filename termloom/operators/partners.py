"""The best partners of each term by shared features, exactly, over inverted indexes in bounded pieces.

A term's features are its categories (worth 100), the set of them (15), its title's tokens (20) and its definition's (2);
a pair's score is what both have.  Pairs count if they share a category.  Terms with equal features score alike, so one
of each kind is looked at.

Each category's kinds are dealt into pieces of bounded size, and a task takes one piece of seekers and one of
holders.  It indexes the holders by feature and serves a seeker rare features first.  Once ``k`` holders score more than
all features still to come are worth together, no new holder can be among the best: the
frequent features are then only looked up for holders that may still reach the k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.functions.text import similarity_tokens
from termloom.sources.shared import kept

#: Kinds in a piece.
SEEKERS, HOLDERS = 4096, 1 << 15
#: What a shared feature is worth, by its mark.
WORTH = {"d": 2, "=": 15, "t": 20, "c": 100}


def profiles(terms: DataFrame) -> DataFrame:
    """``(slug, cats, feats array<long>, sig)``: features as numbers that carry their worth, without those that one term
    alone has; terms with one ``sig`` score alike against every term."""
    none = F.array().cast("array<string>")
    marked = lambda mark, c: F.transform(F.array_distinct(F.coalesce(c, none)), lambda t: F.concat(F.lit(mark), t))
    cats = F.array_sort(F.array_distinct(F.coalesce(F.filter("categories", lambda c: c.isNotNull()), none)))
    own = F.concat(
        marked("t", similarity_tokens(F.concat_ws(" ", "slug", "title_ko", "title_en"))), marked("d", similarity_tokens(F.col("definition"))),
        marked("c", cats), F.array(F.concat(F.lit("="), F.to_json(F.struct(cats)))))
    t = kept(terms.select("slug", cats.alias("cats"), own.alias("own")))
    shared = t.select(F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("df")).filter("df > 1")
    worth = F.coalesce(*[F.when(F.col("f").startswith(m), F.lit(w)) for m, w in WORTH.items()])
    numbered = kept(shared.select("f", (F.monotonically_increasing_id() * 128 + worth).alias("id")))
    feats = t.select("slug", F.explode("own").alias("f")).join(numbered, "f").groupBy("slug").agg(F.array_sort(F.collect_list("id")).alias("feats"))
    p = t.select("slug", "cats").join(feats, "slug", "left").withColumn("feats", F.coalesce("feats", F.array().cast("array<long>")))
    return p.withColumn("sig", F.md5(F.to_json(F.struct("cats", "feats")).cast("binary")))


def _index(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different features, and in CSR form the rows that have each, ascending."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    feats, start = np.unique(flat[order], return_index=True)
    return feats, np.append(start, len(flat)), rows[order]


def best_of(flat: np.ndarray, sizes: np.ndarray, seekers: list[np.ndarray], ks: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each seeker the ``k`` best of the holders and their scores; among equals the one that comes first.

    ``flat`` and ``sizes``: the holders' features, one holder after the other.
    """
    feats, start, rows = _index(flat, sizes)
    n, df = len(sizes), np.diff(start)
    columns: dict[int, np.ndarray] = {}

    def column(f: int) -> np.ndarray:
        if f not in columns:
            columns[f] = np.zeros(n, np.int32)
            columns[f][rows[start[f] : start[f + 1]]] = 1
        return columns[f]

    out = []
    for own, k in zip(seekers, ks, strict=True):
        k = min(k, n)
        at = np.searchsorted(feats, own)
        at = at[(at < len(feats)) & (feats[np.minimum(at, len(feats) - 1)] == own)] if len(feats) else at[:0]
        worth = feats[at] % 128
        base = int(worth[df[at] == n].sum())  # what every holder has decides nothing
        at = at[df[at] < n]
        at = at[np.argsort(df[at], kind="stable")]
        worth = (feats[at] % 128).astype(np.int32)
        left = np.cumsum(worth[::-1])[::-1].tolist()  # worth of a feature and all later ones
        score = np.zeros(n, np.int32)
        few = int(np.searchsorted(df[at], n // 16, "right"))
        for f, w in zip(at[:few].tolist(), worth[:few].tolist(), strict=True):
            score[rows[start[f] : start[f + 1]]] += w
        i, among = few, None
        while i < len(at):
            if among is None and score.max() > left[i]:
                least = int(np.partition(score, n - k)[n - k])
                if least > left[i]:
                    among = np.flatnonzero(score >= least - left[i])
            f, w = int(at[i]), int(worth[i])
            if among is None:
                score += w * column(f)
            else:
                score[among] += w * column(f)[among]
            i += 1
        if among is None:
            among = np.flatnonzero(score >= np.partition(score, n - k)[n - k])
        key = score[among].astype(np.int64) << 32 | (n - among)
        top = among[np.argsort(-key)[:k]]
        out.append((top, score[top] + base))
    return out


FOUND = "sig string, other string, score int"


def partner_kinds(seekers: DataFrame, holders: DataFrame, sizes: tuple[int, int] = (SEEKERS, HOLDERS)) -> DataFrame:
    """``(sig, other, score)``: for each kind of ``seekers`` ``(sig, cats, feats, k)`` the ``k`` best kinds of ``holders``
    ``(sig, cats, feats, least)``, itself included; ties go by ``least``, the first slug of a kind."""
    s = seekers.select("sig", "feats", "k", F.explode("cats").alias("cat"))
    h = holders.select(F.col("sig").alias("other"), F.col("feats").alias("have"), F.col("least").alias("first"), F.explode("cats").alias("cat"))
    pieces = lambda d, size, name: d.groupBy("cat").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    n = kept(pieces(s, sizes[0], "ns").join(pieces(h, sizes[1], "nh"), "cat"))
    # A piece of seekers goes to every piece of holders of its category, and the other way round.
    dealt = lambda d, name, own, other: (
        d.join(n, "cat").withColumn(own, F.pmod(F.xxhash64(name), F.col("n" + own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("n" + other) - 1))).drop("ns", "nh"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sig, other, score = [], [], []
        if len(left) and len(right):
            right = right.sort_by("first").combine_chunks()
            have = right["have"].combine_chunks()
            flat, ends = np.asarray(have.flatten()), np.asarray(have.offsets)
            mine = left["feats"].combine_chunks()
            own, cuts = np.asarray(mine.flatten()), np.asarray(mine.offsets) - mine.offsets[0].as_py()
            names = np.array(right["other"].to_pylist(), object)
            for q, (top, value) in zip(left["sig"].to_pylist(), best_of(flat, np.diff(ends), [own[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], left["k"].to_pylist()), strict=True):
                sig += [q] * len(top)
                other += names[top].tolist()
                score += value.tolist()
        return pa.table({"sig": pa.array(sig, pa.string()), "other": pa.array(other, pa.string()), "score": pa.array(score, pa.int32())})

    by = ["cat", "s", "h"]
    return dealt(s, "sig", "s", "h").groupBy(*by).cogroup(dealt(h, "other", "h", "s").groupBy(*by)).applyInArrow(run, FOUND).distinct()


def ranked_kinds(seekers: DataFrame, holders: DataFrame, members: DataFrame, sizes: tuple[int, int] = (SEEKERS, HOLDERS)) -> DataFrame:
    """``(sig, dst, score, rank)``: the ``k`` best single terms for each kind of ``seekers``, ranked by score, then slug.

    ``members``: ``(sig, slug)`` of the holders.  A kind further back than place ``k`` by score and first slug has ``k`` terms before
    all its own, and so has one below kinds of higher scores with ``k`` terms among them; both are left out before kinds are written out as terms.
    """
    least = members.groupBy("sig").agg(F.min("slug").alias("least"), F.count("*").alias("size"))
    kinds = holders.join(least, "sig")
    found = partner_kinds(seekers, kinds, sizes).join(seekers.select("sig", "k"), "sig").join(least.withColumnRenamed("sig", "other"), "other")
    place = F.row_number().over(W.partitionBy("sig").orderBy(F.desc("score"), "least"))
    above = F.sum("size").over(W.partitionBy("sig").orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, 0)) - F.sum("size").over(W.partitionBy("sig", "score"))
    found = kept(found.withColumn("i", place).filter("i <= k").withColumn("above", above).filter("above < k").select("sig", "other", "score", "k"))
    # The first slugs of a kind that is looked for, as many as any seeker wants: first in parts of it, then of all.
    most = found.groupBy("other").agg(F.max("k").alias("most"))
    rows = members.select(F.col("sig").alias("other"), F.col("slug").alias("dst")).join(most, "other").withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(64)))
    for by in (["other", "part"], ["other"]):
        rows = rows.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("dst"))).filter("i <= most").drop("i")
    out = found.join(rows.select("other", "dst"), "other")
    rank = F.row_number().over(W.partitionBy("sig").orderBy(F.desc("score"), "dst"))
    return out.withColumn("rank", rank).filter("rank <= k").select("sig", "dst", "score", "rank")
