"""Categories, groups and subcategories of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.operators.dictionary import sent_to_all

# The subcategory of terms seen from a category that is not their first,
# and of terms without one in graphs and roadmaps.
RELATED_BUCKET, UNSORTED = "관련 용어", "미분류"
PAGE = 40


def resolve_category(code: Column, known: list[str], aliases: dict[str, list[str]]) -> Column:
    """A known code as itself, an old one as the codes it became, else none."""
    none = F.array().cast("array<string>")
    old = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if aliases else None
    found = F.when(code.isin(*known), F.array(code))
    return F.coalesce(found, old[code], none) if old is not None else F.coalesce(found, none)


def category_counts(terms: DataFrame) -> DataFrame:
    """Terms per category; a term counts under each of its own."""
    return terms.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def primary_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy(F.try_element_at("categories", F.lit(1)).alias("category")).agg(F.count("*").alias("n"))


def featured_counts(terms: DataFrame, featured: DataFrame) -> DataFrame:
    """``featured (category, ord)`` with its counts, 0 where no term is."""
    return featured.join(category_counts(terms), "category", "left").select("category", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def placed(terms: DataFrame) -> DataFrame:
    """``(category, subcategory, slug, term_ord)``: a row for each category of a term.

    Only under its first category does a term keep its subcategory.
    """
    own = F.when((F.col("pos") == 0) & (F.col("subcategory") != ""), F.col("subcategory"))
    return terms.select("slug", "term_ord", "subcategory", F.posexplode("categories").alias("pos", "category")).select(
        "category", F.coalesce(own, F.lit(RELATED_BUCKET)).alias("subcategory"), "slug", "term_ord"
    )


def rollup(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts of placed terms by group, category, subcategory and overall.

    ``groups``: ``(grp, category)``; a category in no group has a null group.  ``level`` is
    0 for subcategories, 1 categories, 3 groups, 7 all.
    """
    return (
        placed(terms).join(sent_to_all(groups), "category", "left")
        .rollup("grp", "category", "subcategory")
        .agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.countDistinct("slug").alias("n_terms"))
    )


def ordered_subcategories(terms: DataFrame, order: DataFrame) -> DataFrame:
    """Subcategories of each category: listed ones ``(category, subcategory, pos)`` in
    list order, the others after them by name; ``opens`` marks the first."""
    found = placed(terms).groupBy("category", "subcategory").agg(F.count("*").alias("n"))
    by = W.partitionBy("category").orderBy(F.col("pos").isNull(), "pos", "subcategory")
    listed = found.join(order, ["category", "subcategory"], "left")
    return listed.withColumn("place", F.row_number().over(by)).withColumn("opens", F.col("place") == 1).drop("pos")


def first_page(terms: DataFrame, page: int = PAGE) -> DataFrame:
    """The first ``page`` terms of each subcategory, with how many more there are."""
    rows, by = placed(terms), ["category", "subcategory"]
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    # The filter on the place alone lets each task keep its first ``page`` rows before the shuffle.
    first = rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("term_ord", "slug"))).filter(F.col("place") <= page)
    return first.join(n, by).select(*by, "slug", "place", F.greatest(F.col("n") - page, F.lit(0)).alias("more"))


def section_starts(categories: DataFrame) -> DataFrame:
    """``(category, ord, grp)`` -> ``new_section`` where the group differs from the one before.

    The list of categories is short and fixed, so one ordered window serves.
    """
    before = F.lag("grp").over(W.partitionBy(F.lit(0)).orderBy("ord"))
    return categories.withColumn("new_section", ~F.coalesce(before.eqNullSafe(F.col("grp")), F.lit(False)) | before.isNull())


def with_labels(rows: DataFrame, labels: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """``label`` of each category code; an unknown code stands for itself, or goes."""
    out = rows.join(sent_to_all(labels.select("category", F.col("label").alias("_label"))), "category", "left" if keep_unknown else "inner")
    return out.withColumn("label", F.coalesce("_label", "category")).drop("_label")


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first appear."""
    return rows.groupBy(value).agg(F.min(order).alias("first_at"))
