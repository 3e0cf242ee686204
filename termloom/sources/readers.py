"""Reading terms, pages and user tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from termloom.operators.ledger import owned

#: A dictionary term.  ``term_ord`` is its place in the file: ties go by it everywhere.
TERM = T.StructType([
    T.StructField("slug", T.StringType()), T.StructField("title_ko", T.StringType()), T.StructField("title_en", T.StringType()),
    T.StructField("definition", T.StringType()), T.StructField("definition_en", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("subcategory", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("related", T.ArrayType(T.StringType())),
    T.StructField("difficulty", T.IntegerType()), T.StructField("prerequisites", T.ArrayType(T.StringType())),
])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, ord)``: lines of text, numbered 0.. by file name and place in the file.

    Files are read in parallel, by blocks; each block counts its lines and starts after those of the blocks before it, so
    one row a block meets in one task.
    """
    block = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.text(path).select("value", block("file_path").alias("_f"), block("file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    sizes = rows.groupBy("_f", "_b").agg(F.count("*").alias("n"), F.min("_i").alias("_first"))
    sizes = sizes.select("_f", "_b", "_first", (F.sum("n").over(W.orderBy("_f", "_b")) - F.col("n")).alias("_start"))
    return rows.join(sizes, ["_f", "_b"]).select("value", (F.col("_start") + F.col("_i") - F.col("_first")).alias("ord"))


def _bracketed(lines: DataFrame, opens: str, closes: str, item: str) -> bool | None:
    """Whether lines are ``opens``, one item each, ``closes``; None where the first character is another one."""
    text = F.trim("value")
    is_open, is_close, blank = text == opens, text == closes, text == ""
    is_item = text.rlike(item)
    c = lines.agg(
        F.min_by(text, F.when(~blank, F.col("ord"))).alias("first"), F.count_if(is_open).alias("o"), F.count_if(is_close).alias("c"), F.count_if(~(is_open | is_close | blank | is_item)).alias("odd"),
        F.min(F.when(is_item, F.col("ord"))).alias("lo"), F.max(F.when(is_item, F.col("ord"))).alias("hi"),
        F.max(F.when(is_open, F.col("ord"))).alias("at"), F.min(F.when(is_close, F.col("ord"))).alias("end")).first()
    if c["first"] is None or not c["first"].startswith(opens):
        return None
    return c["o"] == 1 and c["c"] == 1 and not c["odd"] and (c["lo"] is None or c["at"] < c["lo"] and c["hi"] < c["end"])


def read_terms(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Terms from a JSON array (or JSON lines), with their place.

    An array that has its brackets and each object on lines of their own, as ``write_array`` and other tools of the
    format leave it, is read in parallel: one pass sees that the lines are such and in order, another parses them.
    Any other layout is parsed a file at a time.  A file that is not an array of objects raises.
    """
    known = " or ".join(f"{f.name} is not null" for f in TERM.fields)  # what cannot be parsed comes back as all nulls
    if not lines:
        rows = numbered_lines(spark, path)
        plain = _bracketed(rows, "[", "]", r"^\{.*\},?$")
        if plain is None:
            raise ValueError(f"{path} is not a JSON array")
        if not plain:
            return numbered(spark.read.schema(TERM).option("multiLine", True).json(path).filter(known))
        items = rows.withColumn("value", F.regexp_replace(F.trim("value"), ",$", "")).filter("value <> '' and value not in ('[', ']')")
        parsed = items.select(F.from_json("value", TERM).alias("t"), "ord").select("t.*", "ord").filter(known)
        # Lines that hold no object leave no gap: the opening bracket is the only line before.
        first = parsed.agg(F.min("ord")).first()[0] or 0
        return parsed.withColumn("term_ord", F.col("ord") - first).drop("ord")
    rows = numbered_lines(spark, path).filter(F.trim("value") != "")
    return rows.select(F.from_json("value", TERM).alias("t"), F.col("ord").alias("term_ord")).select("t.*", "term_ord").filter(known)


def numbered(df: DataFrame, name: str = "term_ord") -> DataFrame:
    """Row numbers 0.. in reading order, without a single-task sort: each partition
    counts its rows and starts after those before it (one number per partition)."""
    rows = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_first")).withColumn("_start", F.sum("n").over(W.orderBy("_p")) - F.col("n"))
    return rows.join(F.broadcast(sizes.select("_p", "_first", "_start")), "_p").withColumn(name, F.col("_start") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_start")


def index_of(terms: DataFrame) -> DataFrame:
    """The narrow columns that browsing needs."""
    return terms.select("slug", "title_ko", "title_en", "categories", "subcategory", "aliases", "term_ord")


def with_defaults(terms: DataFrame) -> DataFrame:
    """Known columns only; missing arrays are empty."""
    return terms.select(*[F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else f.name for f in TERM.fields])


def read_pages(spark: SparkSession, path: str, exclude: tuple[str, ...] = ("node_modules", ".git")) -> DataFrame:
    """``(slug, path, html, modified)`` of all .html files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    for part in exclude:
        files = files.filter(~F.col("path").contains(f"/{part}/"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.html$", "")
    return files.select(name.alias("slug"), "path", F.col("content").cast("string").alias("html"), F.col("modificationTime").alias("modified"))


def read_rows(spark: SparkSession, kind: str, user_id, columns: list[str] | None = None, user: str = "user_id", **options) -> DataFrame:
    """A user table out of any Spark data source (``parquet``, ``jdbc``, ..), the user's own rows only.

    Filter and columns are part of the plan, so sources that can apply them do."""
    rows = owned(spark.read.format(kind).options(**options).load(), user_id, user)
    return rows.select(*columns) if columns else rows


def read_maps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(key, value)`` of several JSON objects of texts; a later file's keys replace earlier ones, and a later line's those before it.

    Objects with their braces and each pair on lines of their own are read in parallel; others a file at a time."""
    kind, out = "map<string,string>", None
    for i, path in enumerate(paths):
        rows = numbered_lines(spark, path)
        if _bracketed(rows, "{", "}", r'^".*"\s*:.*[^{\[],?$'):
            pair = F.concat(F.lit("{"), F.regexp_replace(F.trim("value"), ",$", ""), F.lit("}"))
            one = rows.filter(~F.trim("value").isin("{", "}", "")).select(F.explode(F.from_json(pair, kind)).alias("key", "value"), F.struct(F.lit(i), "ord").alias("_f"))
        else:
            one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "value"), F.struct(F.lit(i), F.lit(0).cast("long").alias("ord")).alias("_f"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("key").agg(F.max_by("value", "_f").alias("value"))


def read_history(spark: SparkSession, path: str, mark: str = "commit ") -> DataFrame:
    """``(path, ts)`` out of an exported log: records that start with ``mark`` and an id, a line ``Date: `` with an ISO time, and after a
    blank line the paths that the record touches, one a line.

    Spark splits the file at the marks, so a record is a row and its header meets its paths without a shuffle.
    """
    record = spark.read.option("lineSep", "\n" + mark).text(path).withColumn("value", F.regexp_replace("value", "^" + mark, ""))
    when = F.try_to_timestamp(F.regexp_extract("value", r"(?m)^Date:\s*(\S+)\s*$", 1))
    touched = F.split(F.regexp_extract("value", r"(?s)\n\n(.*)$", 1), "\n")
    return record.select(when.alias("ts"), F.explode(touched).alias("path")).select(F.trim("path").alias("path"), "ts").filter("path <> '' and ts is not null")


def page_dates(pages: DataFrame, history: DataFrame) -> DataFrame:
    """Last and first dates from a history ``(path, ts)``, else the file's own."""
    known = history.groupBy("path").agg(F.max("ts").alias("_last"), F.min("ts").alias("_first"))
    return pages.join(known, "path", "left").withColumn("last_changed", F.coalesce("_last", "modified")).withColumn("first_added", F.coalesce("_first", "modified")).drop("_last", "_first")


def page_text(items: DataFrame) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, page, item, text)``: items joined by spaces, pages by line feeds."""
    pages = items.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item", "text"))), lambda x: x["text"]), " ").alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n")
    return pages.groupBy("doc_id").agg(F.trim(joined).alias("text"))


def has_text(items: DataFrame, probe: int = 3) -> DataFrame:
    """Whether any of a document's first pages has text at all."""
    return items.filter(F.col("page") < probe).groupBy("doc_id").agg(F.bool_or(F.coalesce(F.trim("text") != "", F.lit(False))).alias("has_text"))


def stored_list(raw: str, kind: str = "array<string>"):
    """A stored JSON list; what cannot be read counts as empty."""
    return F.coalesce(F.from_json(raw, kind), F.array().cast(kind))


def query_param(url: str, name: str):
    return F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(name))


def resolve_redirects(links: DataFrame, redirects: DataFrame, column: str = "slug") -> DataFrame:
    """``column`` with old slugs replaced by the ones they redirect to (one hop); of several targets the greatest."""
    r = redirects.groupBy(F.col("from_slug").alias(column)).agg(F.max("to_slug").alias("to_slug"))
    return links.join(r, column, "left").withColumn(column, F.coalesce("to_slug", column)).drop("to_slug")


def unknown_keys(updates: DataFrame, terms: DataFrame, key: str = "slug") -> DataFrame:
    """Keys of updates that no term bears."""
    return updates.select(key).distinct().join(terms.select(key), key, "left_anti")


def map_update(terms: DataFrame, updates: DataFrame, column: str, only_if_empty: bool = False, strict: bool = False) -> DataFrame:
    """``column`` from ``updates (slug, value)`` where there is one.

    ``only_if_empty`` keeps what is filled; ``strict`` raises if a key is no term.  Where updates name a slug more
    than once the one of greatest ``ord`` counts, if they have that column, else the greatest value.
    """
    by = F.col("ord") if "ord" in updates.columns else F.col("value")
    if strict:
        if unknown_keys(updates, terms).limit(1).count():
            raise ValueError("updates name slugs that are no terms")
    both = terms.join(updates.groupBy("slug").agg(F.max_by("value", by).alias("_v")), "slug", "left")
    old = F.col(column)
    empty = old.isNull() | ((F.size(old) == 0) if isinstance(terms.schema[column].dataType, T.ArrayType) else (old == ""))
    return both.withColumn(column, F.when(F.col("_v").isNotNull() & (empty if only_if_empty else F.lit(True)), F.col("_v")).otherwise(old)).drop("_v")
