"""Extraction and data-quality queries over ``pages``, ``documents``, ``labels`` and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import extract as E
from termloom.operators import quality as Q
from termloom.plans.common import part_terms, table
from termloom.sources.readers import query_param


def html_links(spark, sf_dir):
    return E.link_table(table(spark, sf_dir, "pages"))


HTML_LINKS = """SELECT page_id, unnest(generate_series(0, len(h) - 1))::INT AS pos, unnest(h) AS href
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages) WHERE len(h) > 0"""


def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", E.title(F.col("html"), T.slug_of(F.col("url"))).alias("title"), T.slug_of(F.col("url")).alias("slug"))


HTML_TITLE = r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), ''),
  regexp_replace(string_split(url, '/')[-1], '(?i)\.html?$', '')) AS title, regexp_replace(string_split(url, '/')[-1], '(?i)\.html?$', '') AS slug FROM pages"""


def html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


HTML_TEXT = """SELECT page_id, length(t)::INT AS n_chars, sha256(t) AS text_sha256
FROM (SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS t FROM pages)"""


def html_markers(spark, sf_dir):
    marks = Q.has_marks({"nav": "<nav>", "article": "<article>", "ad": 'class="ad"'})
    return table(spark, sf_dir, "pages").select("page_id", *marks, F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("n_p"))


HTML_MARKERS = """SELECT page_id, contains(html, '<nav>') AS nav, contains(html, '<article>') AS article, contains(html, 'class="ad"') AS ad,
  len(regexp_extract_all(html, '<p>'))::INT AS n_p FROM pages"""


def related_links(spark, sf_dir):
    """Slugs of .html pages linked; the synthetic pages link to bare paths, so the ending is added first."""
    html = F.regexp_replace("html", r'href="/([^".]*)"', 'href="/$1.html?x"')
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(E.page_slugs(E.hrefs(html)), "|").alias("slugs"))


RELATED_LINKS = r"""WITH h AS (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, 'href="/([^".]*)"', 'href="/\1.html?x"', 'g'), 'href="([^"]*)"', 1)) AS h,
         generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages
), s AS (SELECT page_id, regexp_extract(h, '(?:^|/)([^/]+)\.html(?:[?#].*)?$', 1) AS s, min(i) AS i FROM h GROUP BY 1, 2)
SELECT p.page_id, coalesce(string_agg(s, '|' ORDER BY i) FILTER (s <> ''), '') AS slugs FROM pages p LEFT JOIN s ON s.page_id = p.page_id GROUP BY 1"""


def related_block_links(spark, sf_dir):
    """Slugs of a page's first related-terms block only: its first two links, put into one, with a second block after the page."""
    html = F.regexp_replace("html", r'href="/([^".]*)"', 'href="/$1.html?x"')
    cut = F.split(html, "<a ", 4)
    rest = F.when(F.size(cut) > 3, F.concat(F.lit("<a "), cut[3])).otherwise("")
    framed = F.when(F.size(cut) > 2, F.concat(cut[0], F.lit('<div class="related-terms"><a '), cut[1], F.lit("<a "), cut[2], F.lit("</div>"), rest)).otherwise(html)
    both = F.concat(framed, F.lit('<div class="related-terms"><a href="later.html">x</a></div>'))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(E.related_slugs(both), "|").alias("slugs"))


RELATED_BLOCK_LINKS = r"""WITH h AS (SELECT page_id, regexp_replace(html, 'href="/([^".]*)"', 'href="/\1.html?x"', 'g') AS html FROM pages
), c AS (SELECT page_id, html, string_split(html, '<a ') AS p FROM h
), b AS (
  SELECT page_id, CASE WHEN len(p) > 2 THEN p[1] || '<div class="related-terms"><a ' || p[2] || '<a ' || p[3] || '</div>' || CASE WHEN len(p) > 3 THEN '<a ' || array_to_string(p[4:], '<a ') ELSE '' END ELSE html END
    || '<div class="related-terms"><a href="later.html">x</a></div>' AS html FROM c
), l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<div class="related-terms">(.*?)</div>', 1), 'href="([^"]*)"', 1) AS hs FROM b
), s AS (SELECT page_id, regexp_extract(hs[i], '(?:^|/)([^/]+)\.html(?:[?#].*)?$', 1) AS s, min(i) AS i FROM (SELECT page_id, hs, unnest(generate_series(1, len(hs))) AS i FROM l) GROUP BY 1, 2)
SELECT p.page_id, coalesce(string_agg(s, '|' ORDER BY i) FILTER (s <> ''), '') AS slugs FROM pages p LEFT JOIN s ON s.page_id = p.page_id GROUP BY 1"""


def url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", query_param("url", "page").alias("page"), T.url_component(F.col("url")).alias("encoded"))


URL_PARTS = """SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, url_encode(url) AS encoded FROM pages"""


def block_upsert(spark, sf_dir):
    """A marked block put before each page's end of head, twice: the second time changes nothing."""
    args = ("<!-- tag -->", "<!-- /tag -->", "<meta name='x' content='$1'>", "</head>")
    once = table(spark, sf_dir, "pages").select("page_id", E.upsert_block(F.col("html"), *args).alias("a"))
    twice = once.select("page_id", "a.html", "a.outcome", E.upsert_block(F.col("a.html"), *args).alias("b"))
    return twice.select("page_id", "outcome", F.col("b.outcome").alias("again"), F.sha2("html", 256).alias("html_sha256"))


BLOCK_UPSERT = """SELECT page_id, CASE WHEN contains(html, '</head>') THEN 'added' ELSE 'no-anchor' END AS outcome,
  CASE WHEN contains(html, '</head>') THEN 'unchanged' ELSE 'no-anchor' END AS again,
  sha256(CASE WHEN contains(html, '</head>') THEN left(html, strpos(html, '</head>') - 1) || '<!-- tag --><meta name=''x'' content=''$1''><!-- /tag -->' || chr(10) || substring(html, strpos(html, '</head>')) ELSE html END) AS html_sha256 FROM pages"""


def dq_missing_fields(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn")).withColumn("role", F.when(F.col("role") != "system", F.col("role")))
    return Q.missing_fields(c, ["role", "text"], "key")


DQ_MISSING_FIELDS = """SELECT 'missing field' AS rule, 'error' AS severity, conv_id || '-' || turn AS key, f AS detail FROM (
  SELECT *, unnest(['role', 'text']) AS f FROM conversations) WHERE (f = 'role' AND (role = 'system' OR coalesce(role, '') = '')) OR (f = 'text' AND coalesce(text, '') = '')"""


def dq_bad_slugs(spark, sf_dir):
    return Q.bad_slugs(table(spark, sf_dir, "part").select(F.lower("p_name").alias("slug"))).groupBy("rule", "severity", "key").agg(F.count("*").alias("n"))


DQ_BAD_SLUGS = """SELECT 'slug format' AS rule, 'error' AS severity, lower(p_name) AS key, count(*) AS n FROM part
WHERE NOT regexp_full_match(lower(p_name), '[a-z0-9]+(?:-[a-z0-9]+)*') GROUP BY 3"""


def dq_orphans(spark, sf_dir):
    """Documents and labels against each other, both ways."""
    return Q.drift(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "documents", "labels")


DQ_ORPHANS = """SELECT 'not in labels' AS rule, 'error' AS severity, doc_id::VARCHAR AS key, NULL::VARCHAR AS detail FROM (SELECT DISTINCT doc_id FROM documents) d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'not in documents', 'error', doc_id::VARCHAR, NULL FROM (SELECT DISTINCT doc_id FROM labels) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)"""


def dq_customers_without_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


DQ_CUSTOMERS_WITHOUT_ORDERS = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


def dq_duplicates(spark, sf_dir):
    return Q.duplicates(table(spark, sf_dir, "part"), "p_name")


DQ_DUPLICATES = "SELECT 'duplicate key' AS rule, 'error' AS severity, p_name AS key, count(*)::VARCHAR AS detail FROM part GROUP BY p_name HAVING count(*) > 1"


def dq_spelling_drift(spark, sf_dir):
    """Part names written in several ways: half of them with hyphens for spaces."""
    form = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name"))
    return Q.spelling_drift(table(spark, sf_dir, "part").select(form.alias("title_en")), "title_en")


DQ_SPELLING_DRIFT = r"""WITH f AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS form FROM part),
k AS (SELECT lower(regexp_replace(form, '[\s·・\-–—_/()\[\]{},.]+', '', 'g')) AS key, form FROM f)
SELECT 'spelling drift in title_en' AS rule, 'error' AS severity, key, string_agg(form, ' / ' ORDER BY form) AS detail FROM k GROUP BY key HAVING count(*) > 1"""


def dq_translation_drift(spark, sf_dir):
    """One name, several types."""
    return Q.translation_drift(table(spark, sf_dir, "part").select(F.col("p_name").alias("title_ko"), F.col("p_type").alias("title_en")))


DQ_TRANSLATION_DRIFT = r"""SELECT 'several translations' AS rule, 'error' AS severity, trim(p_name) AS key, count(DISTINCT lower(regexp_replace(p_type, '[\s·・\-–—_/()\[\]{},.]+', '', 'g')))::VARCHAR AS detail
FROM part GROUP BY trim(p_name) HAVING count(*) > 1 AND count(DISTINCT lower(regexp_replace(p_type, '[\s·・\-–—_/()\[\]{},.]+', '', 'g'))) > 1"""


def dq_same_title(spark, sf_dir):
    return Q.same_title(part_terms(spark, sf_dir).withColumn("title_ko", F.col("title_en")).withColumn("categories", F.array("subcategory")), every=True)


DQ_SAME_TITLE = """WITH t AS (SELECT DISTINCT p_name FROM part GROUP BY p_name, p_brand HAVING count(*) > 1)
SELECT 'same title in category' AS rule, 'error' AS severity, p_name AS key, string_agg('part-' || p_partkey, ', ' ORDER BY 'part-' || p_partkey) AS detail FROM part JOIN t USING (p_name) GROUP BY p_name"""


def dq_report(spark, sf_dir):
    found = Q.drift(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "documents", "labels").unionByName(Q.duplicates(table(spark, sf_dir, "part"), "p_name"))
    return Q.report(found).select("rule", "severity", "n", "sample", "more")


DQ_REPORT = f"""WITH f AS (({DQ_ORPHANS}) UNION ALL ({DQ_DUPLICATES})), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY key, detail) AS i FROM f)
SELECT rule, severity, count(*) AS n, string_agg(key, ', ' ORDER BY key) FILTER (i <= 15) AS sample, greatest(count(*) - 15, 0) AS more FROM r GROUP BY rule, severity"""


def alias_offers(spark, sf_dir):
    """Search variants of part names and types that no other part claims or bears."""
    t = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("slug"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title_ko"),
        F.concat_ws(" of ", "p_type", "p_brand").alias("title_en"), F.array("p_brand").alias("aliases"))
    return Q.new_aliases(t).select("slug", F.array_join("aliases", "|").alias("aliases"))


ALIAS_OFFERS = r"""WITH t AS (
  SELECT 'p' || p_partkey AS slug, p_name || ' ' || p_partkey AS ko, p_type || ' of ' || p_brand AS en, p_brand FROM part
), w AS (
  SELECT *, list_filter(string_split_regex(en, '[\s\-]+'), lambda x: x <> '' AND lower(x) NOT IN ('of','the','and','in','for','to','a','an','on','with','by')) AS c FROM t
), v AS (
  SELECT slug, p_brand, unnest(list_concat(CASE WHEN contains(ko, ' ') THEN [replace(ko, ' ', '')] ELSE [] END,
    CASE WHEN regexp_matches(ko, '[·・\-–—/]+') THEN [regexp_replace(ko, '[·・\-–—/]+', '', 'g'), trim(regexp_replace(ko, '[·・\-–—/]+', ' ', 'g'))] ELSE [] END,
    CASE WHEN len(c) BETWEEN 2 AND 5 AND len(list_filter(c, lambda x: NOT regexp_matches(x, '^[A-Za-z]'))) = 0 THEN [array_to_string(list_transform(c, lambda x: upper(left(x, 1))), '')] ELSE [] END)) AS v FROM w
), o AS (
  SELECT DISTINCT slug, v, lower(v) AS low FROM v
  WHERE lower(v) <> lower(p_brand) AND lower(v) NOT IN (SELECT lower(ko) FROM t UNION SELECT lower(en) FROM t)
), s AS (SELECT low FROM o GROUP BY low HAVING count(*) = 1)
SELECT slug, string_agg(v, '|' ORDER BY v) AS aliases FROM o JOIN s USING (low) GROUP BY slug"""


def batch_merge(spark, sf_dir):
    """Labelled documents as a batch onto the English ones; texts of 400 characters or more have a page."""
    docs = table(spark, sf_dir, "documents")
    have = docs.filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("slug"))
    batch = table(spark, sf_dir, "labels").select((F.col("doc_id") - F.col("doc_id") % 2).cast("string").alias("slug"), F.when(F.col("quality") == 1, "x").alias("title"), F.col("doc_id").alias("ord"))
    pages = docs.filter("n_chars >= 400").select(F.col("doc_id").cast("string").alias("slug"))
    return Q.merge_batch(have, batch, pages, ["slug", "title"]).select("slug", "ord", "fate")


BATCH_MERGE = """WITH b AS (SELECT (doc_id - doc_id % 2) AS s, quality, doc_id AS ord FROM labels), k AS (
  SELECT b.*, b.s IN (SELECT doc_id FROM documents WHERE lang = 'en') AS old, b.s IN (SELECT doc_id FROM documents WHERE n_chars >= 400) AS paged FROM b
), m AS (SELECT *, min(CASE WHEN quality = 1 AND NOT old AND paged THEN ord END) OVER (PARTITION BY s) AS taken FROM k)
SELECT s::VARCHAR AS slug, ord, CASE WHEN quality IS DISTINCT FROM 1 THEN 'missing fields' WHEN old THEN 'already there' WHEN taken < ord THEN 'repeated in batch' WHEN NOT paged THEN 'no page' ELSE 'accepted' END AS fate FROM m"""

def tag_balance(spark, sf_dir):
    return Q.tag_balance(table(spark, sf_dir, "pages"))


TAG_BALANCE = r"""WITH t AS (SELECT page_id, html, unnest(['div', 'p', 'ul', 'li', 'a', 'article', 'nav']) AS tag FROM pages),
c AS (SELECT page_id, tag, len(regexp_extract_all(html, '(?i)<' || tag || '[\s>]'))::INT AS opened, len(regexp_extract_all(html, '(?i)</' || tag || '\s*>'))::INT AS closed FROM t)
SELECT * FROM c WHERE opened <> closed"""


def site_summary(spark, sf_dir):
    """Documents as terms, pages by number."""
    terms = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"))
    return Q.site_summary(terms, table(spark, sf_dir, "pages").select((F.col("page_id") * 3).alias("slug"), "html"), "</article>")


SITE_SUMMARY = """SELECT (SELECT count(*) FROM documents) AS terms, (SELECT count(doc_id) - count(DISTINCT doc_id) FROM documents) AS repeated,
  (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages WHERE NOT contains(html, '</article>')) AS no_footer,
  (SELECT count(*) FROM (SELECT DISTINCT page_id * 3 AS s FROM pages) WHERE s NOT IN (SELECT doc_id FROM documents)) AS orphan_pages,
  (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT page_id * 3 FROM pages)) AS missing_pages"""

_NAMES = [
    "html_links", "html_title", "html_text", "html_markers", "related_links", "related_block_links", "url_parts", "block_upsert", "dq_missing_fields", "dq_bad_slugs", "dq_orphans",
    "dq_customers_without_orders", "dq_duplicates", "dq_spelling_drift", "dq_translation_drift", "dq_same_title", "dq_report", "alias_offers", "batch_merge", "tag_balance", "site_summary",
]
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {n: globals()[n.upper()] for n in _NAMES}
