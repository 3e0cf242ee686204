"""Search over term titles and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.operators.dictionary import alias_keys
from termloom.operators.ranking import placed_in_group


def search_rank(query: str, *fields: Column, aliases: Column | None = None) -> Column:
    """0 where a field equals the query, 1 where one begins with it, 2 where one
    contains it, else null; in lower case.  An empty query ranks nothing."""
    q = query.strip().lower()
    every = F.transform(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), F.lower)
    if aliases is not None:
        every = F.concat(every, F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower))
    if not q:
        return F.lit(None).cast("int")
    return (
        F.when(F.exists(every, lambda f: f == q), 0)
        .when(F.exists(every, lambda f: f.startswith(q)), 1)
        .when(F.exists(every, lambda f: f.contains(q)), 2)
    )


def browse(terms: DataFrame, query: str = "", categories: list[str] | None = None) -> DataFrame:
    """Terms that match, with ``rank`` and ``position`` 1..: best tier first, then input order.

    Without a query all match; ``categories`` keeps terms in any of them.  Rows come
    in no order of their own: sort by ``position``.
    """
    rank = search_rank(query, F.col("title_ko"), F.col("title_en"), aliases=F.col("aliases"))
    out = terms.withColumn("rank", rank)
    if query.strip():
        out = out.filter(F.col("rank").isNotNull())
    if categories:
        out = out.filter(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    cells = [F.coalesce("rank", F.lit(0)), F.floor(F.col("term_ord") / 65_536)]
    return placed_in_group(out.withColumn("_all", F.lit(0)), ["_all"], cells, ["term_ord", "slug"], "position").drop("_all")


def contains_filter(terms: DataFrame, query: str) -> DataFrame:
    """Category-page filter: the query is part of a title; aliases do not count."""
    q = query.strip().lower()
    return terms.filter(F.lower("title_ko").contains(q) | F.lower("title_en").contains(q))


def near_titles(terms: DataFrame, query: str, threshold: float = 0.4) -> DataFrame:
    """``(slug, score)`` by the least edit distance over length of a title or alias.

    Stands in for a fuzzy-search library, whose scores it does not reproduce.
    """
    q = query.strip().lower()
    names = F.array_compact(F.concat(F.array("title_ko", "title_en"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = terms.select("slug", "term_ord", F.explode(names).alias("name")).filter("name <> ''")
    score = F.levenshtein(F.lower("name"), F.lit(q)) / F.greatest(F.length("name"), F.lit(len(q)))
    return rows.groupBy("slug").agg(F.min(score).alias("score"), F.min("term_ord").alias("term_ord")).filter(F.col("score") <= threshold)


def header_search(terms: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Exact title or alias hits, then near ones, each term once, the first ``limit``."""
    q = query.strip().lower()
    exact = alias_keys(terms).filter(F.col("key") == q).join(terms.select("slug", "term_ord"), "slug").select("slug", F.lit(0).alias("tier"), F.lit(0.0).alias("score"), "term_ord")
    near = near_titles(terms, query).select("slug", F.lit(1).alias("tier"), "score", "term_ord")
    best = exact.unionByName(near).withColumn("n", F.row_number().over(W.partitionBy("slug").orderBy("tier", "score")))
    return best.filter("n = 1").drop("n").orderBy("tier", "score", "term_ord").limit(limit)


def near_words(words: DataFrame, keys: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """``(word, key, score, place)``: dictionary keys one edit away from words that are no keys.

    Off in the matcher; for finding typing errors.  Words of ``least`` letters or more, at
    most ``share`` of the longer one changed, the best three keys.  Strings one edit
    apart agree once a letter is left out of either or both, so pairs meet on such
    forms, one per letter, and never by cross join.
    """
    own = words.select("word").distinct().filter(F.length("word") >= least).join(keys.select(F.col("key").alias("word")), "word", "left_anti")

    def forms(df: DataFrame, c: str) -> DataFrame:
        shorter = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
        return df.select(c, F.explode(F.array_distinct(F.array_append(shorter, F.col(c)))).alias("form"))

    pairs = forms(own, "word").join(forms(keys.select("key").distinct().filter(F.length("key") >= least - 1), "key"), "form").select("word", "key").distinct()
    edits = F.levenshtein("word", "key")
    scored = pairs.filter(edits <= 1).withColumn("score", edits / F.greatest(F.length("word"), F.length("key"))).filter(F.col("score") <= share)
    return scored.withColumn("place", F.row_number().over(W.partitionBy("word").orderBy("score", "key"))).filter("place <= 3")
