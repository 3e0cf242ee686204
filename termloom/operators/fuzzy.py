"""Many near searches at once over an inverted index of letter pairs.

Pairs of neighbouring letters, the ends counted as letters, survive edits: of a query's ``len + 1`` pairs (one that occurs twice
counts twice) an insertion breaks one, any other edit two.  A name that is ``d`` letters longer takes ``d`` insertions at
least, so ``e`` edits break ``2 e - d`` pairs at most, and of that many pairs and one more, one is in every match.  A query is
therefore looked up by that many of its rarest pairs, and never meets names that share but the commonest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.sources.shared import kept

#: The weights of a term's fields.
FIELD_WEIGHTS = {"title_ko": 0.55, "title_en": 0.3, "alias": 0.15}


def letter_pairs(text: Column) -> Column:
    """``array<struct<pair, nth>>``: pairs of neighbouring letters, ends included, each with the number of its occurrence."""
    closed = F.concat(F.lit("\u0002"), text, F.lit("\u0003"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(closed) - 1), lambda i: F.substring(closed, i, F.lit(2)))
    return F.transform(F.array_distinct(pairs), lambda p: F.struct(p.alias("pair"), F.size(F.filter(pairs, lambda q: q == p)).alias("n")))


def _grams(rows: DataFrame, text: str) -> DataFrame:
    """``(text, pair, nth)``: one row for each occurrence."""
    each = rows.select(text, F.explode(letter_pairs(F.col(text))).alias("g"))
    return each.select(text, F.col("g.pair").alias("pair"), F.explode(F.sequence(F.lit(1), F.col("g.n"))).alias("nth"))


def fields_of(terms: DataFrame) -> DataFrame:
    """``(slug, term_ord, field, name)``: a term's names in lower case, without empty ones."""
    alias = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("alias").alias("field"), a.alias("name")))
    titles = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("name")) for c in ("title_ko", "title_en")])
    rows = terms.select("slug", "term_ord", F.explode(F.concat(titles, alias)).alias("f"))
    return rows.select("slug", "term_ord", F.col("f.field").alias("field"), F.lower(F.trim("f.name")).alias("name")).filter("name <> ''")


def name_index(names: DataFrame) -> DataFrame:
    """``(pair, nth, name, len)``: the inverted index over different names; write it where many batches use it."""
    each = names.select("name").distinct()
    return _grams(each, "name").select("pair", "nth", "name", F.length("name").alias("len"))


def near_names(queries: DataFrame, index: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``(query, name, share)``: names whose edit distance to a query is at most ``threshold`` of the longer one's length.

    ``queries (query)`` in lower case.  Exact for thresholds under one half, where any match shares a pair.
    """
    if not 0 <= threshold < 0.5:
        raise ValueError("threshold must be at least 0 and under one half")
    q = queries.select("query").filter("query <> ''").distinct().withColumn("qlen", F.length("query"))
    df = kept(index.groupBy("pair", "nth").agg(F.count("*").alias("df")))
    grams = _grams(q, "query").join(q, "query").join(df, ["pair", "nth"], "left")
    # Pairs of the query that a match may lack, over the lengths that the longer of the two may have.
    edits = lambda m: F.floor(m * threshold + 1e-9)
    lengths = F.sequence(F.col("qlen"), F.floor(F.col("qlen") / (1 - threshold) + 1e-9).cast("int"))
    lost = F.array_max(F.transform(lengths, lambda m: 2 * edits(m) - (m - F.col("qlen"))))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.coalesce("df", F.lit(0)), "pair", "nth"))
    probes = grams.withColumn("place", place).filter((F.col("place") <= lost + 1) & F.col("df").isNotNull()).select("query", "qlen", "pair", "nth")
    longest = F.greatest("len", "qlen")
    met = probes.join(index, ["pair", "nth"]).filter(F.abs(F.col("len") - F.col("qlen")) <= edits(longest)).select("query", "name").distinct()
    share = F.levenshtein("query", "name") / F.greatest(F.length("query"), F.length("name"))
    return met.withColumn("share", share).filter(F.col("share") <= threshold)


def search_many(queries: DataFrame, terms: DataFrame, threshold: float = 0.4, limit: int = 8, weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """``(query, slug, tier, score, place)``: the first ``limit`` terms for each query.

    Terms with a name that equals the query come first (tier 0), in input order; then near ones by ``score``: over a term's fields the
    weight times how much of the nearest name stays (1 less its share of edits), added up, highest first, then input order.  The
    scores of the fuzzy-search library are not reproduced.  Queries count once each, trimmed and in lower case; null
    and empty ones find nothing.
    """
    names = kept(fields_of(terms))
    asked = queries.select(F.lower(F.trim("query")).alias("query"))
    found = near_names(asked, name_index(names), threshold)
    per_field = found.join(names, "name").groupBy("query", "slug", "field").agg(F.min("share").alias("share"), F.min("term_ord").alias("term_ord"))
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in weights.items()])
    # Added up in a fixed order, so that equal names give equal scores.
    parts = F.array_sort(F.collect_list(F.round(weight * (1 - F.col("share")), 9).cast("decimal(12,9)")))
    hits = per_field.groupBy("query", "slug").agg(
        F.aggregate(parts, F.lit(0).cast("decimal(12,9)"), lambda a, x: (a + x).cast("decimal(12,9)")).cast("double").alias("score"),
        F.min(F.when(F.col("share") == 0, 0).otherwise(1)).alias("tier"), F.min("term_ord").alias("term_ord"))
    place = F.row_number().over(W.partitionBy("query").orderBy("tier", F.when(F.col("tier") == 1, -F.col("score")), "term_ord", "slug"))
    return hits.withColumn("place", place).filter(F.col("place") <= limit).select("query", "slug", "tier", "score", "place")
