"""Writers: JSON lines, partitioned copies, sitemap, feed, page templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import date_only, escape_html, escape_xml, url_component, utc_string
from termloom.operators.ranking import placed_in_group

FEED_ITEMS = 30


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, in parallel files."""
    df.write.mode("overwrite").json(path)


def _bracketed(lines: DataFrame, opens: str, closes: str, path: str) -> None:
    """``(ord, value)`` between two brackets, each on a line of its own and all but the last with a comma.

    The lines are dealt out by ranges of ``ord``, whose first and last parts carry the brackets: the files, one after the
    other by name, are the document, and no task holds more than its range.
    """
    ends = lines.agg(F.min("ord"), F.max("ord"), F.count("*"), F.countDistinct("ord")).first()
    if ends[2] != ends[3]:
        raise ValueError("places are not unique")
    low, high = (ends[0], ends[1]) if ends[2] else (0, 0)
    comma = lines.select(F.col("ord").cast("long").alias("ord"), F.concat("value", F.when(F.col("ord") < high, ",").otherwise("")).alias("value"))
    brackets = lines.sparkSession.createDataFrame([(low - 1, opens), (high + 1, closes)], "ord long, value string")
    comma.unionByName(brackets).repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)


def write_array(df: DataFrame, path: str, indent: str = "  ") -> None:
    """A JSON array, a line for each object, in order of ``term_ord``, which must be unique; ``indent`` "" for the compact form."""
    one = F.to_json(F.struct(*[c for c in df.columns if c != "term_ord"]))
    _bracketed(df.select(F.col("term_ord").alias("ord"), F.concat(F.lit(indent), one).alias("value")), "[", "]", path)


def write_pretty(df: DataFrame, path: str) -> None:
    """A JSON array as people read it: each object over several lines, two blanks a level, in order of ``term_ord``."""
    one = F.to_json(F.struct(*[c for c in df.columns if c != "term_ord"]), {"pretty": "true"})
    deeper = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(one, " : ", ": "), "\n", "\n  "))
    _bracketed(df.select(F.col("term_ord").alias("ord"), deeper.alias("value")), "[", "]", path)


def write_map(rows: DataFrame, path: str) -> None:
    """``(key, value)`` as one JSON object, a pair a line; a null value is null.  Pairs come in order of a hash of the key, whose
    first digits are sorted apart."""
    pair = F.to_json(F.create_map("key", "value"), {"ignoreNullFields": "false"})
    pairs = rows.select("key", F.concat(F.lit("  "), pair.substr(F.lit(2), F.length(pair) - 2)).alias("value"))
    ranged = placed_in_group(pairs.withColumn("_all", F.lit(0)), ["_all"], [F.left(F.sha2("key", 256), F.lit(3))], ["key"], "ord")
    _bracketed(ranged.select("ord", "value"), "{", "}", path)


def write_pages(pages: DataFrame, root: str) -> None:
    """``(path, html)``: every page as a file of its own below ``root``, through the file system of that
    path, by the tasks that hold the pages."""
    def put(batches):
        import pyarrow as pa
        import pyarrow.fs as fs

        where, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for b in batches:
            for name, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(f"{base}/{name}") as out:
                    out.write((html or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    pages.select("path", "html").mapInArrow(put, "n long").agg(F.sum("n")).first()


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log, a folder a day; what is there stays."""
    rows.withColumn("day", date_only(F.col("ts"))).write.mode("append").partitionBy("day").parquet(path)


def page_manifest(static: DataFrame, terms: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """All pages ``(ord, path, ..)``: static ones, then term pages, numbered on; ``auth_nav`` is true
    unless ``overrides (path, auth_nav)`` says otherwise."""
    last = static.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("_next"), F.lit(1).alias("_one"))
    after = terms.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").withColumn("ord", F.col("ord") + F.col("_next")).drop("_one", "_next")
    pages = static.withColumn("is_term", F.lit(False)).unionByName(after.withColumn("is_term", F.lit(True)))
    if overrides is None:
        return pages.withColumn("auth_nav", F.lit(True))
    return pages.join(overrides.select("path", F.col("auth_nav").alias("_nav")), "path", "left").withColumn("auth_nav", F.coalesce("_nav", F.lit(True))).drop("_nav")


def appended(pages: DataFrame, added: DataFrame) -> DataFrame:
    """The pages of a sitemap and those of a later round after them; it is then rendered as a whole."""
    return page_manifest(pages.select("ord", "path", "modified"), added.select("ord", "path", "modified")).select("ord", "path", "modified")


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(slug, part, ord)``: slugs of the first list, then those of the second, each once at its first place."""
    both = first.select("slug", F.lit(0).alias("part"), "ord").unionByName(second.select("slug", F.lit(1).alias("part"), "ord"))
    return both.groupBy("slug").agg(F.min(F.struct("part", "ord")).alias("f")).select("slug", "f.part", "f.ord")


def write_index(terms: DataFrame, path: str) -> None:
    terms.write.mode("overwrite").parquet(path)


def write_by_category(terms: DataFrame, path: str) -> None:
    """A folder for each primary category.  One shuffle brings a category's rows
    together, spread over several files where a category is large."""
    rows = terms.withColumn("primary_category", F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit("none")))
    spread = F.pmod(F.xxhash64("slug"), F.lit(8))
    rows.repartition("primary_category", spread).write.mode("overwrite").partitionBy("primary_category").parquet(path)


#: Nodes of a group in one document.
CHUNK = 1000


def subgraphs(nodes: DataFrame, edges: DataFrame, size: int = CHUNK) -> DataFrame:
    """``(grp, chunk, nodes, edges)``: each group as documents for a graph viewer.

    A chunk holds up to ``size`` nodes in order of ``term_ord`` and the edges that start at them, so that no row grows with
    its group, only with the links of ``size`` terms.
    """
    placed = placed_in_group(nodes, ["grp"], [F.floor(F.col("term_ord") / 65_536)], ["term_ord", "slug"])
    at = placed.withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("int"))
    n = at.groupBy("grp", "chunk").agg(F.sort_array(F.collect_list(F.struct("term_ord", "slug", "title"))).alias("nodes"))
    own = edges.join(at.select(F.col("slug").alias("src"), "grp", "chunk"), ["src", "grp"])
    e = own.groupBy("grp", "chunk").agg(F.sort_array(F.collect_list(F.array("src", "dst"))).alias("edges"))
    return n.join(e, ["grp", "chunk"], "left").withColumn("edges", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)))


def write_subgraphs(nodes: DataFrame, edges: DataFrame, path: str, size: int = CHUNK) -> None:
    """``subgraphs`` as JSON documents below ``path/data`` by ranges of group and chunk, and ``path/manifest``: of each group its
    number of chunks, nodes and edges."""
    spark = nodes.sparkSession
    subgraphs(nodes, edges, size).repartitionByRange("grp", "chunk").sortWithinPartitions("grp", "chunk").write.mode("overwrite").json(f"{path}/data")
    written = spark.read.schema("grp string, chunk int, nodes array<struct<slug:string>>, edges array<array<string>>").json(f"{path}/data")
    counts = written.groupBy("grp").agg(F.count("*").alias("chunks"), F.sum(F.size("nodes").cast("long")).alias("nodes"), F.sum(F.size("edges").cast("long")).alias("edges"))
    counts.write.mode("overwrite").json(f"{path}/manifest")


def sitemap_entries(pages: DataFrame, base: str) -> DataFrame:
    """``(ord, loc, lastmod)`` of ``(ord, path, modified)``."""
    loc = F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(F.transform(F.split("path", "/"), url_component), "/"))
    return pages.select("ord", loc.alias("loc"), date_only(F.col("modified")).alias("lastmod"))


# What a sitemap is made of, and the entries that one file may hold.
SITEMAP_NS, SITEMAP_MOST = "http://www.sitemaps.org/schemas/sitemap/0.9", 50_000
_DECLARED = 'version="1.0" encoding="UTF-8"'


def write_sitemap(pages: DataFrame, base: str, path: str, most: int = SITEMAP_MOST) -> int:
    """Sitemap files of at most ``most`` entries below ``path``, in order of ``ord``, and below ``path`` + ``_index`` one that names them.

    Spark's XML source writes ranges of the pages side by side, escapes what needs it and reads the files back: the number of entries
    must be that of pages.
    """
    spark, path = pages.sparkSession, path.rstrip("/")
    xml = {"declaration": _DECLARED, "indent": ""}
    entries = sitemap_entries(pages, base).repartitionByRange("ord").sortWithinPartitions("ord").select("loc", "lastmod")
    entries.write.mode("overwrite").options(**xml, rootTag=f'urlset xmlns="{SITEMAP_NS}"', rowTag="url", maxRecordsPerFile=most).format("xml").save(path)
    back = read_sitemap(spark, path)
    files = back.groupBy(F.col("file").alias("loc")).agg(F.count("*").alias("n"), F.max("lastmod").alias("lastmod"))
    index = files.select(F.concat(F.lit(base.rstrip("/") + "/"), "loc").alias("loc"), "lastmod", "n")
    index.select("loc", "lastmod").write.mode("overwrite").options(**xml, rootTag=f'sitemapindex xmlns="{SITEMAP_NS}"', rowTag="sitemap").format("xml").save(f"{path}_index")
    written = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if written != pages.count():
        raise ValueError(f"{written} entries written for {pages.count()} pages")
    return written


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``(loc, lastmod, file)`` of the files that ``write_sitemap`` left."""
    rows = spark.read.format("xml").schema("loc string, lastmod string").option("rowTag", "url").load(path)
    return rows.select("loc", "lastmod", F.col("_metadata.file_name").alias("file"))


def feed_document(items: DataFrame, base: str, title: str, description: str, language: str = "ko", limit: int = FEED_ITEMS) -> DataFrame:
    """``(xml)``: the whole feed, one row: the channel and the newest items in order.  ``limit`` bounds it."""
    newest = feed_items(items, base, limit)
    each = newest.agg(F.sort_array(F.collect_list(F.struct(-F.unix_micros(F.col("added").cast("timestamp")), "term_ord", "xml"))).alias("i"), F.max("added").alias("built"))
    built = utc_string(F.coalesce("built", F.lit("1970-01-01").cast("timestamp")))
    say = lambda tag, text: F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>\n"))
    head = F.concat(
        say("title", escape_xml(F.lit(title))), say("link", escape_xml(F.lit(base.rstrip("/") + "/"))), say("description", escape_xml(F.lit(description))), say("language", F.lit(language)), say("lastBuildDate", built))
    body = F.array_join(F.transform("i", lambda x: x["xml"]), "\n")
    return each.select(F.concat(F.lit(f'<?xml {_DECLARED}?>\n<rss version="2.0">\n<channel>\n'), head, body, F.lit("\n</channel>\n</rss>\n")).alias("xml"))


def feed_items(items: DataFrame, base: str, limit: int = FEED_ITEMS) -> DataFrame:
    """The newest items ``(slug, title, text, added, term_ord)`` as RSS elements, in order."""
    newest = items.orderBy(F.desc("added"), "term_ord").limit(limit)
    link = F.concat(F.lit(base.rstrip("/") + "/terms/"), url_component(F.col("slug")), F.lit(".html"))
    xml = F.concat(
        F.lit("<item><title>"), escape_xml(F.col("title")), F.lit("</title><link>"), escape_xml(link), F.lit("</link><pubDate>"),
        utc_string(F.col("added")), F.lit("</pubDate><description>"), escape_xml(F.coalesce("text", F.lit(""))), F.lit("</description></item>"),
    )
    return newest.select("slug", "added", "term_ord", xml.alias("xml"))


def english_pages(terms: DataFrame) -> DataFrame:
    """``(slug, html)``: the English page, or a note that the translation is pending."""
    done = F.col("definition_en") != ""
    body = F.when(done, F.concat(F.lit("<p>"), escape_html(F.col("definition_en"), None), F.lit("</p>"))).otherwise(F.lit("<p>Translation pending.</p>"))
    title = escape_html(F.coalesce("title_en", "slug"), None)
    html = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><title>'), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>"), F.coalesce(body, F.lit("<p>Translation pending.</p>")), F.lit("</body></html>"))
    return terms.select("slug", html.alias("html"))


def english_index(terms: DataFrame) -> DataFrame:
    """One row: how many of the terms are translated, and of how many."""
    return terms.agg(F.count_if(F.coalesce(F.col("definition_en") != "", F.lit(False))).alias("translated"), F.count("*").alias("total"))


def english_list(terms: DataFrame) -> DataFrame:
    """``(slug, term_ord, html)``: a list item for each translated term."""
    done = terms.filter(F.coalesce(F.col("definition_en") != "", F.lit(False)))
    item = F.concat(F.lit('<li><a href="terms/'), F.col("slug"), F.lit('.html">'), escape_html(F.coalesce("title_en", "slug"), None), F.lit("</a></li>"))
    return done.select("slug", "term_ord", item.alias("html"))


def with_chrome(pages: DataFrame, header: str, footer: str, base: str = "") -> DataFrame:
    """Page bodies between a header and a footer in which ``{base}`` is the relative root."""
    return pages.withColumn("html", F.concat(F.lit(header.replace("{base}", base)), F.col("html"), F.lit(footer.replace("{base}", base))))


def related_block(links: DataFrame, terms: DataFrame) -> DataFrame:
    """``(slug, html)`` of each term's related links ``(src, dst, pos)``; an unknown one raises."""
    titled = links.join(terms.select(F.col("slug").alias("dst"), "title_ko"), "dst", "left")
    item = F.concat(F.lit('<a href="'), F.col("dst"), F.lit('.html">'), escape_html(F.col("title_ko")), F.lit("</a>"))
    checked = F.when(F.col("title_ko").isNull(), F.raise_error(F.concat(F.lit("no such term: "), F.col("dst")))).otherwise(item)
    own = titled.groupBy(F.col("src").alias("slug")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", checked.alias("a")))), lambda x: x["a"]), "\n").alias("a"))
    return own.select("slug", F.concat(F.lit('<div class="related-terms">'), F.col("a"), F.lit("</div>")).alias("html"))
