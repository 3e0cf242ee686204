"""Tables as the plans see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dictionary terms: type as category, brand as subcategory."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("slug"),
        F.lit("").alias("title_ko"),
        F.col("p_name").alias("title_en"),
        F.concat_ws(" ", "p_name", "p_type").alias("definition"),
        F.array("p_type").alias("categories"),
        F.col("p_brand").alias("subcategory"),
        F.array("p_type", "p_brand").alias("aliases"),
        F.col("p_partkey").alias("term_ord"),
    )


#: Lines of orders that one task takes, so that its memory does not grow with the table.
LINES = 250_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks over the lines or over what follows from them: as many more as the table is longer."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def co_bought(spark: SparkSession, sf_dir: str, groups: DataFrame | None = None) -> DataFrame:
    """``(src, dst)`` links: parts that share an order, both ways, each once; only inside ``groups`` ``(l_partkey, grp)``, if given.

    An order has a bounded number of lines, so the self join stays linear.  Groups are known before lines meet, so
    that no link between two of them is made.
    """
    n, by = line_tasks(spark, sf_dir), ["l_orderkey"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    if groups is not None:
        lines, by = lines.join(groups, "l_partkey"), ["l_orderkey", "grp"]
    # Dealt first and then made different: one stage, and no table of all pairs of a task before the shuffle.
    lines = lines.repartition(n, *by).distinct()
    a, b = lines.alias("a"), lines.withColumnRenamed("l_partkey", "other").alias("b")
    once = a.join(b, by).filter("l_partkey < other").select("l_partkey", "other").repartition(n, "l_partkey", "other").distinct()
    ways = F.array(F.struct(F.col("l_partkey").alias("src"), F.col("other").alias("dst")), F.struct(F.col("other").alias("src"), F.col("l_partkey").alias("dst")))
    return once.select(F.inline(ways))


def returned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_partkey)``: parts of which at least half the lines, of all there are, were returned."""
    back = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((2 * F.count_if(F.col("l_returnflag") == "R") >= F.count("*")).alias("back"))
    return back.filter("back").select("l_partkey")


RETURNED_PARTS = "(SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING 2 * count(*) FILTER (l_returnflag = 'R') >= count(*))"
