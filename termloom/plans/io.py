"""Writers and readers as round trips: a table goes out to a fresh shared folder and comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.plans.common import co_bought, line_tasks, part_terms, table
from termloom.sources import readers, sinks
from termloom.sources.shared import fresh_path
from termloom.streaming import state as ST


def _dictionary(spark, sf_dir):
    t = part_terms(spark, sf_dir)
    return t.select("slug", "title_ko", "title_en", "definition", "categories", "subcategory", "aliases", F.when(F.col("term_ord") > 9, F.array("slug")).alias("related"), "term_ord")


def stored_terms(spark, sf_dir):
    """Terms as JSON lines, read back with defaults and numbered."""
    path = fresh_path(spark)
    sinks.write_lines(_dictionary(spark, sf_dir).drop("term_ord"), path)
    t = readers.read_terms(spark, path, lines=True)
    full = readers.with_defaults(t)
    return full.select("slug", "title_en", F.size("related").alias("n_related"), F.size("prerequisites").alias("n_prerequisites"))


STORED_TERMS = "SELECT 'part-' || p_partkey AS slug, p_name AS title_en, CASE WHEN p_partkey > 9 THEN 1 ELSE 0 END AS n_related, 0 AS n_prerequisites FROM part"


def stored_array(spark, sf_dir):
    """Parts as one JSON array over several files, read back in parallel with their order."""
    path = fresh_path(spark)
    sinks.write_array(_dictionary(spark, sf_dir), path)
    return readers.read_terms(spark, path).select("slug", "title_en", F.coalesce(F.size("related"), F.lit(0)).alias("n_related"), F.col("term_ord").cast("long").alias("term_ord"))


STORED_ARRAY = "SELECT 'part-' || p_partkey AS slug, p_name AS title_en, CASE WHEN p_partkey > 9 THEN 1 ELSE 0 END AS n_related, row_number() OVER (ORDER BY p_partkey) - 1 AS term_ord FROM part"


def stored_pretty(spark, sf_dir):
    """Suppliers as JSON that people read; such layouts are read a file at a time."""
    path = fresh_path(spark)
    t = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("slug"), F.lit('a "b"').alias("title_en"), F.array(F.col("s_nationkey").cast("string")).alias("categories"), F.col("s_suppkey").alias("term_ord"))
    sinks.write_pretty(t, path)
    text = readers.numbered_lines(spark, path)
    return text.filter("value rlike '^    .slug'").select(F.regexp_extract("value", r'"slug": "(.*)",$', 1).alias("slug"), (F.col("ord") % 7).alias("at"))


STORED_PRETTY = "SELECT s_name AS slug, (2 + 5 * (row_number() OVER (ORDER BY s_suppkey) - 1)) % 7 AS at FROM supplier"


def stored_index(spark, sf_dir):
    """The narrow index, and the copy by primary category, each read back."""
    a, b = fresh_path(spark), fresh_path(spark)
    t = _dictionary(spark, sf_dir)
    sinks.write_index(readers.index_of(t), a)
    sinks.write_by_category(t, b)
    by = spark.read.parquet(b).groupBy(F.col("primary_category").alias("category")).agg(F.count("*").alias("n"))
    return by.unionByName(spark.read.parquet(a).agg(F.lit("index").alias("category"), F.count("slug").alias("n")).select("category", "n"))


STORED_INDEX = "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'index', count(*) FROM part"


def stored_pages(spark, sf_dir):
    """Pages as .html files of their own in nested folders, found again by their names.

    File by file on purpose: that is what the reader is for.  The writer spreads them over tasks."""
    path = fresh_path(spark)
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html")
    sinks.write_pages(p, path)
    return readers.read_pages(spark, path).select("slug", F.sha2("html", 256).alias("html_sha256"))


STORED_PAGES = "SELECT 'p' || page_id AS slug, sha256(html) AS html_sha256 FROM pages"


def stored_maps(spark, sf_dir):
    """Two JSON objects: suppliers' nations, then customers' of the same key; the later wins."""
    paths = []
    for name, key, value in (("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey")):
        rows = table(spark, sf_dir, name).select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
        paths.append(fresh_path(spark))
        sinks.write_map(rows, paths[-1])
    return readers.read_maps(spark, paths)


STORED_MAPS = """SELECT coalesce(c_custkey, s_suppkey)::VARCHAR AS key, coalesce(c_nationkey, s_nationkey)::VARCHAR AS value
FROM customer FULL JOIN supplier ON s_suppkey = c_custkey"""


def page_dates(spark, sf_dir):
    """Customers as files with their orders as history; those without orders keep a fixed date."""
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.lit("1990-01-01").cast("timestamp").alias("modified"))
    history = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return readers.page_dates(pages, history).select("path", day("last_changed"), day("first_added"))


PAGE_DATES = """SELECT c_custkey AS path, coalesce(strftime(max(o_orderdate), '%Y-%m-%d'), '1990-01-01') AS last_changed, coalesce(strftime(min(o_orderdate), '%Y-%m-%d'), '1990-01-01') AS first_added
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""


def log_dates(spark, sf_dir):
    """Orders as an exported log: the customer is the file that a record touches, and its nation's page another; dates out of the log."""
    path = fresh_path(spark)
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    record = F.concat(F.lit("commit "), F.col("o_orderkey").cast("string"), F.lit("\nAuthor: x\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n\nterms/"), F.col("c_custkey").cast("string"), F.lit(".html\nnation/"), F.col("c_nationkey").cast("string"), F.lit(".html\n"))
    o.select(record.alias("value")).write.text(path)
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("terms/"), F.col("c_custkey").cast("string"), F.lit(".html")).alias("path")).unionByName(
        table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"), F.lit(".html")).alias("path")))
    found = readers.page_dates(pages.withColumn("modified", F.lit("1990-01-01").cast("timestamp")), readers.read_history(spark, path))
    return found.select("path", F.date_format("last_changed", "yyyy-MM-dd").alias("last_changed"), F.date_format("first_added", "yyyy-MM-dd").alias("first_added"))


LOG_DATES = """WITH h AS (SELECT unnest(['terms/' || c_custkey || '.html', 'nation/' || c_nationkey || '.html']) AS path, o_orderdate AS t FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT path, coalesce(strftime(max(t), '%Y-%m-%d'), '1990-01-01') AS last_changed, coalesce(strftime(min(t), '%Y-%m-%d'), '1990-01-01') AS first_added
FROM (SELECT 'terms/' || c_custkey || '.html' AS path FROM customer UNION ALL SELECT 'nation/' || n_nationkey || '.html' FROM nation) p LEFT JOIN h USING (path) GROUP BY 1"""


def page_texts(spark, sf_dir):
    """Conversations as documents of pages: turns are pages, lines their items."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("item", "text"))
    t = readers.page_text(c).join(readers.has_text(c), "doc_id", "left")
    return t.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


PAGE_TEXTS = """SELECT conv_id AS doc_id, sha256(trim(string_agg(replace(coalesce(text, ''), chr(10), ' '), chr(10) ORDER BY turn))) AS text_sha256,
  coalesce(bool_or(trim(replace(coalesce(text, ''), chr(10), ' ')) <> '') FILTER (turn < 3), false) AS has_text FROM conversations GROUP BY 1"""


def user_rows(spark, sf_dir):
    """One user's errors as any data source gives them, here Parquet; the filter reaches the scan."""
    return readers.read_rows(spark, "parquet", 8, columns=["event_id", "value"], path=f"{sf_dir}/events.parquet")


USER_ROWS = "SELECT event_id, value FROM events WHERE user_id = 8"


def stored_lists(spark, sf_dir):
    """Stored JSON that may be broken: properties cut short on errors."""
    e = table(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_type") == "error", F.left("props", F.lit(5))).when(F.col("event_type") != "view", F.concat(F.lit('["'), F.col("event_type"), F.lit('", "b"]'))))
    return e.select("event_id", F.array_join(readers.stored_list("raw"), "|").alias("items"))


STORED_LISTS = "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN '' ELSE event_type || '|b' END AS items FROM events"


def appended_log(spark, sf_dir):
    """A search log written in two appends, one for each half of the month, and read back."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.get_json_object("props", "$.k").alias("query"), "ts", F.lit(0).alias("result_count"))
    path = fresh_path(spark)
    for half in (F.dayofmonth("ts") <= 15, F.dayofmonth("ts") > 15):
        sinks.append_log(e.filter(half), path)
    return spark.read.parquet(path).groupBy("query").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


APPENDED_LOG = "SELECT props::JSON->>'k' AS query, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events WHERE event_type = 'error' GROUP BY 1"


def upserted_rows(spark, sf_dir):
    """Events as a stream of micro-batches folded into a table of the last event of each user and type."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    source, target = fresh_path(spark), fresh_path(spark)
    e.repartitionByRange(3, "ts").write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source)
    q = ST.upserts(stream, target, ["user_id", "event_type"], fresh_path(spark), buckets=8)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return ST.upserted(spark, target, e.schema).select("user_id", "event_type", "event_id")


UPSERTED_ROWS = """SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1"""


def sitemap(spark, sf_dir):
    """Static pages (regions) and term pages (nations), then customers as an appended round."""
    at = lambda t, key, base, folder: table(spark, sf_dir, t).select((F.col(key) + base).cast("long").alias("ord"), F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(".html")).alias("path"), F.lit("2026-08-01").cast("timestamp").alias("modified"))
    pages = sinks.page_manifest(at("region", "r_regionkey", 0, "page "), at("nation", "n_nationkey", 0, "terms/n"))
    every = sinks.appended(pages, at("customer", "c_custkey", 0, "terms/c"))
    path = fresh_path(spark)
    sinks.write_sitemap(every, "https://example.org", path)
    return sinks.read_sitemap(spark, path).select("loc", F.col("lastmod").alias("day"))


SITEMAP = """SELECT 'https://example.org/' || p AS loc, '2026-08-01' AS day FROM (
  SELECT 'page%20' || r_regionkey || '.html' AS p FROM region UNION ALL SELECT 'terms/n' || n_nationkey || '.html' FROM nation UNION ALL SELECT 'terms/c' || c_custkey || '.html' FROM customer)"""


def page_options(spark, sf_dir):
    """The manifest's options: true unless an override says otherwise."""
    static = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("path"))
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("path"))
    off = table(spark, sf_dir, "region").filter("r_name < 'B'").select(F.col("r_name").alias("path"), F.lit(False).alias("auth_nav"))
    return sinks.page_manifest(static, terms, off).select("ord", "path", "is_term", "auth_nav")


PAGE_OPTIONS = """SELECT r_regionkey::BIGINT AS ord, r_name AS path, false AS is_term, r_name >= 'B' AS auth_nav FROM region
UNION ALL SELECT n_nationkey + (SELECT count(*) FROM region), n_name, true, true FROM nation"""


def translated_slugs(spark, sf_dir):
    """Pilot pages (the benchmark's numbers) first, then translated documents (labelled good ones), each once."""
    pilot = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slug"), F.col("item_id").alias("ord"))
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("slug"), F.col("doc_id").alias("ord"))
    return sinks.ordered_union(pilot, done)


TRANSLATED_SLUGS = """WITH u AS (SELECT item_id AS slug, 0 AS part, item_id AS ord FROM benchmark UNION ALL SELECT doc_id, 1, doc_id FROM labels WHERE quality = 1),
f AS (SELECT slug, min((part, ord)) AS f FROM u GROUP BY 1) SELECT slug, f[1]::INT AS part, f[2] AS ord FROM f"""


def subgraph_documents(spark, sf_dir):
    """Brands as subcategories: their parts and the links inside, in documents of 50 parts, and what the manifest says of each."""
    from termloom.operators.graph import grouped, inner_edges, undirected

    t = part_terms(spark, sf_dir)
    nodes = grouped(t)
    slug = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string")).alias(c)
    e = co_bought(spark, sf_dir, nodes.select(F.col("term_ord").alias("l_partkey"), "grp")).select(slug("src"), slug("dst"), F.lit(0).alias("pos"))
    inner = inner_edges(nodes, e)
    once = undirected(inner.withColumn("src_ord", F.col("src")), tasks=line_tasks(spark, sf_dir))
    edges = once.join(nodes.select(F.col("slug").alias("src"), "grp"), "src")
    path = fresh_path(spark)
    sinks.write_subgraphs(nodes.join(t.select("slug", F.col("title_en").alias("title")), "slug"), edges, path, 50)
    data = spark.read.schema("grp string, chunk int, nodes array<struct<slug:string>>, edges array<array<string>>").json(f"{path}/data")
    whole = spark.read.schema("grp string, chunks long, nodes long, edges long").json(f"{path}/manifest")
    return data.join(whole.select("grp", "chunks", F.col("edges").alias("all_edges")), "grp").select(
        "grp", "chunk", "chunks", "all_edges", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.col("nodes")[0]["slug"].alias("first"))


SUBGRAPH_DOCUMENTS = """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
n AS (SELECT p_brand AS grp, p_partkey AS k, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 50 AS chunk FROM part),
e AS (SELECT DISTINCT CASE WHEN 'part-' || a.l_partkey < 'part-' || b.l_partkey THEN a.l_partkey ELSE b.l_partkey END AS x, CASE WHEN 'part-' || a.l_partkey < 'part-' || b.l_partkey THEN b.l_partkey ELSE a.l_partkey END AS y
  FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey),
i AS (SELECT p.grp, p.chunk, count(*) AS n FROM e JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE p.grp = q.grp GROUP BY 1, 2)
SELECT n.grp, n.chunk::INT AS chunk, max(w.chunks) AS chunks, max(w.all_edges) AS all_edges, count(*)::INT AS n_nodes, coalesce(max(i.n), 0)::INT AS n_edges, 'part-' || min(n.k) AS first
FROM n LEFT JOIN i ON i.grp = n.grp AND i.chunk = n.chunk
JOIN (SELECT grp, count(DISTINCT n.chunk) AS chunks, coalesce(any_value(s.t), 0)::BIGINT AS all_edges FROM n LEFT JOIN (SELECT grp, sum(n) AS t FROM i GROUP BY 1) s USING (grp) GROUP BY 1) w ON w.grp = n.grp
GROUP BY n.grp, n.chunk"""


def english_pages(spark, sf_dir):
    """Term pages: parts over size 25 are translated."""
    t = part_terms(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_ord"), "p_size"), "term_ord")
    t = t.withColumn("definition_en", F.when(F.col("p_size") > 25, F.concat_ws(" < ", "title_en", "subcategory")))
    pages = sinks.with_chrome(sinks.english_pages(t), '<a href="{base}index.html">', "</a>", "../")
    return pages.select("slug", F.sha2("html", 256).alias("html_sha256"))


ENGLISH_PAGES = """SELECT 'part-' || p_partkey AS slug, sha256('<a href="../index.html"><!DOCTYPE html><html lang="en"><head><title>' || p_name || '</title></head><body><h1>' || p_name || '</h1>'
  || CASE WHEN p_size > 25 THEN '<p>' || p_name || ' &lt; ' || p_brand || '</p>' ELSE '<p>Translation pending.</p>' END || '</body></html></a>') AS html_sha256 FROM part"""


def english_index(spark, sf_dir):
    """The index of translated parts: how many, of how many, and the list, by type."""
    t = part_terms(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_ord"), "p_size"), "term_ord")
    t = t.withColumn("definition_en", F.when(F.col("p_size") > 45, F.col("title_en")))
    counts = sinks.english_index(t).select(F.lit("counts").alias("row"), F.col("translated").alias("a"), F.col("total").alias("b"), F.lit("").alias("html"))
    rows = sinks.english_list(t)
    return counts.unionByName(rows.select(F.col("slug").alias("row"), F.col("term_ord").alias("a"), F.lit(0).cast("long").alias("b"), "html"))


ENGLISH_INDEX = """SELECT 'counts' AS row, count(*) FILTER (p_size > 45) AS a, count(*) AS b, '' AS html FROM part
UNION ALL SELECT 'part-' || p_partkey, p_partkey, 0, '<li><a href="terms/part-' || p_partkey || '.html">' || p_name || '</a></li>' FROM part WHERE p_size > 45"""


def feed(spark, sf_dir):
    """The newest thirty orders as feed items."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("slug"), F.concat_ws(" & ", "o_orderstatus", "o_orderpriority").alias("title"), F.lit(None).cast("string").alias("text"),
        F.col("o_orderdate").cast("timestamp").alias("added"), F.col("o_orderkey").alias("term_ord"))
    return sinks.feed_items(o, "https://example.org").select("slug", "xml")


FEED = """SELECT o_orderkey::VARCHAR AS slug, '<item><title>' || o_orderstatus || ' &amp; ' || o_orderpriority || '</title><link>https://example.org/terms/' || o_orderkey || '.html</link><pubDate>'
  || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><description></description></item>' AS xml FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30"""



def feed_document(spark, sf_dir):
    """The whole feed of the newest orders, read back as XML: the channel, and the items it holds."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("slug"), F.concat_ws(" & ", "o_orderstatus", "o_orderpriority").alias("title"), F.lit(None).cast("string").alias("text"),
        F.col("o_orderdate").cast("timestamp").alias("added"), F.col("o_orderkey").alias("term_ord"))
    xml = sinks.feed_document(o, "https://example.org", "Orders & more", "The newest")
    channel = F.from_xml("xml", "channel struct<title:string,language:string,lastBuildDate:string,item:array<struct<title:string,link:string>>>").alias("f")
    return xml.select(channel).select("f.channel.title", "f.channel.language", F.col("f.channel.lastBuildDate").alias("built"), F.posexplode("f.channel.item").alias("place", "i")).select(
        F.col("title").alias("feed"), "language", "built", "place", F.col("i.title").alias("title"), F.col("i.link").alias("link"))


FEED_DOCUMENT = """WITH n AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30)
SELECT 'Orders & more' AS feed, 'ko' AS language, strftime((SELECT max(o_orderdate) FROM n), '%a, %d %b %Y %H:%M:%S GMT') AS built,
  (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1)::INT AS place, o_orderstatus || ' & ' || o_orderpriority AS title, 'https://example.org/terms/' || o_orderkey || '.html' AS link FROM n"""

_NAMES = [
    "feed_document", "stored_pretty", "log_dates", "stored_terms", "stored_array", "stored_index", "stored_pages", "stored_maps", "page_dates", "page_texts", "user_rows", "stored_lists", "appended_log", "upserted_rows", "sitemap",
    "page_options", "translated_slugs", "subgraph_documents", "english_pages", "english_index", "feed",
]
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {n: globals()[n.upper()] for n in _NAMES}
