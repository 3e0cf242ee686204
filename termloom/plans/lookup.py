"""Matching with a two-language dictionary, cards, leaves, redirects and name tables.

The given tables hold Latin text only.  So that Hangul keys, particles and everyday words
are met in whole tables, one fixed substitution turns each Latin letter into a syllable: some
letters become particles, and ``an`` becomes an everyday word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import dictionary as D
from termloom.operators import extract as E
from termloom.operators import matching as M
from termloom.operators import taxonomy as X
from termloom.plans.common import co_bought, line_tasks, part_terms, table
from termloom.sources import readers, sinks

LATIN, HANGUL = "abcdefghijklmnopqrstuvwxyz", "단버코디은포고하이주가라만계오피큐로에도우브와스야즈"


def hangul(c: Column) -> Column:
    return F.translate(F.lower(c), LATIN, HANGUL)


def korean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hangul(F.col("text")).alias("text"))


def korean_terms(spark, sf_dir):
    """The benchmark's words: in Hangul as the Korean title, as they are as the English one."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return words.select(
        F.col("w").alias("slug"), hangul(F.col("w")).alias("title_ko"), F.concat("w", F.lit("-x")).alias("title_en"), F.lit(None).cast("string").alias("definition"),
        F.array(F.lit("bench")).alias("categories"), F.lit(None).cast("int").alias("difficulty"), F.lit(0).alias("term_ord"),
    )


def match_korean(spark, sf_dir):
    m = M.match_terms(korean_texts(spark, sf_dir), korean_terms(spark, sf_dir))
    return m.select("doc_id", "slug", F.col("count").alias("n"), "n_starts", "first_start", "first_length", "rank")


_PARTICLES = ", ".join(f"'{p}'" for p in T.PARTICLES)
_AMBIGUOUS = ", ".join(f"'{w}'" for w in D.AMBIGUOUS_TITLES)
_KOREAN = f"""texts AS (
  SELECT doc_id, translate(lower(text), '{LATIN}', '{HANGUL}') AS text FROM documents
), bw AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark
), ko AS (
  SELECT w AS slug, translate(w, '{LATIN}', '{HANGUL}') AS title FROM bw
), dict AS MATERIALIZED (
  SELECT DISTINCT slug, key FROM (
    SELECT slug, title AS key FROM ko WHERE title NOT IN ({_AMBIGUOUS})
    UNION ALL SELECT w, w || 'x' FROM bw)
  WHERE length(key) >= 2 AND key NOT IN ({_PARTICLES})
), pieces AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?s)(.*?)({T.WORD})', 1)) AS gap,
         unnest(regexp_extract_all(text, '(?s)(.*?)({T.WORD})', 2)) AS word,
         generate_subscripts(regexp_extract_all(text, '(?s)(.*?)({T.WORD})', 2), 1) AS pos
  FROM texts
), words AS (
  SELECT doc_id, word, regexp_replace(lower(word), '[-_\\s]', '', 'g') AS form,
         sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) AS start FROM pieces
), particles AS (
  SELECT unnest([{_PARTICLES}]) AS p, generate_subscripts([{_PARTICLES}], 1) AS ord
), known AS MATERIALIZED (
  SELECT form, slug, 0 AS form_ord, 0 AS cut FROM (SELECT DISTINCT form FROM words) JOIN dict ON form = key
  UNION ALL
  SELECT form, slug, ord, length(p) FROM (SELECT DISTINCT form FROM words) JOIN particles ON suffix(form, p) AND length(form) > length(p) JOIN dict ON left(form, length(form) - length(p)) = key
), hits AS (
  SELECT doc_id, slug, start, length(word) - cut AS length, form_ord FROM words JOIN known USING (form)
), matches AS (
  SELECT doc_id, slug, count(*) AS n, count(DISTINCT start) AS n_starts, min(start) AS first_start, min((start, length)) AS first, min((start, form_ord)) AS seen FROM hits GROUP BY ALL
)"""
MATCH_KOREAN = f"""WITH {_KOREAN} SELECT doc_id, slug, n, n_starts, first_start::INT AS first_start, first[2]::INT AS first_length,
  row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen, slug)::INT AS rank FROM matches"""


def korean_spans(spark, sf_dir):
    """The general sweep over the spans of every occurrence."""
    m = M.match_terms(korean_texts(spark, sf_dir), korean_terms(spark, sf_dir))
    spans = m.select("doc_id", "slug", F.col("rank").alias("ord"), F.inline("occurrences"))
    return M.sweep_spans(spans).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum("length").cast("long").alias("n_chars"), F.sum(F.size("covered")).cast("long").alias("n_covered"))


KOREAN_SPANS = f"""WITH {_KOREAN}, s AS (
  SELECT doc_id, start, max(length) AS length, count(DISTINCT slug) AS n FROM hits GROUP BY doc_id, start
) SELECT doc_id, count(*) AS n_spans, sum(length)::BIGINT AS n_chars, sum(n)::BIGINT AS n_covered FROM s GROUP BY doc_id"""


def term_cards(spark, sf_dir):
    """Parts as matches; the largest have no definition, the smallest no difficulty."""
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("slug"), hangul(F.col("p_name")).alias("title_ko"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("title_en"),
        F.when(F.col("p_size") <= 40, F.concat_ws(" & ", "p_type", "p_brand")).alias("definition"), F.when(F.col("p_size") > 3, F.col("p_size") % 5).alias("difficulty"))
    return M.term_cards(p)


TERM_CARDS = f"""WITH t AS (
  SELECT 'part-' || p_partkey AS slug, translate(lower(p_name), '{LATIN}', '{HANGUL}') AS ko, CASE WHEN p_size > 10 THEN p_name END AS en,
         CASE WHEN p_size <= 40 THEN p_type || ' &amp; ' || p_brand END AS def, CASE WHEN p_size > 3 THEN p_size % 5 END AS d FROM part
), l AS (SELECT *, CASE d WHEN 1 THEN '쉬움' WHEN 2 THEN '보통' WHEN 3 THEN '어려움' END AS label FROM t)
SELECT slug, '<li class="term-card" data-slug="' || slug || '"><span class="term-card-name">' || ko || coalesce(' <span class="term-en">(' || en || ')</span>', '')
  || coalesce('<span class="term-card-difficulty" data-difficulty="' || d || '">' || label || '</span>', '') || '</span>'
  || coalesce('<p class="term-card-definition">' || def || '</p>', '') || '<a href="terms/' || slug || '.html" class="term-card-detail">→</a></li>' AS html FROM l"""


def leaf_ranges(spark, sf_dir):
    """Turns of a conversation as leaves of one page; each benchmark item's length, from ten on, as a range of it."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("leaf"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = c.filter("leaf = 0").select("page_id", F.lit(0).alias("range_id"), F.lit(10).alias("start"), (F.length("text") + 40).alias("end"))
    return M.clip_to_leaves(c, ranges).select("page_id", "leaf", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"))


LEAF_RANGES = """WITH c AS (SELECT conv_id AS page_id, turn AS leaf, coalesce(text, '') AS text FROM conversations),
l AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY leaf) - 1 AS e FROM c),
r AS (SELECT page_id, 10 AS s, length(text) + 40 AS e FROM c WHERE leaf = 0)
SELECT l.page_id, l.leaf, (greatest(r.s, l.e - length(text)) - (l.e - length(text)))::BIGINT AS "from", (least(r.e, l.e) - (l.e - length(text)))::BIGINT AS "to"
FROM l JOIN r USING (page_id) WHERE l.e - length(text) < r.e AND l.e > r.s"""


def browse_categories(spark, sf_dir):
    """Parts of two types, in browsing order."""
    from termloom.operators.search import browse

    return browse(part_terms(spark, sf_dir), "", ["ECONOMY", "PROMO"]).select("slug", "position")


BROWSE_CATEGORIES = """SELECT 'part-' || p_partkey AS slug, row_number() OVER (ORDER BY p_partkey) AS position FROM part WHERE p_type IN ('ECONOMY', 'PROMO')"""


def resolved_categories(spark, sf_dir):
    """Market segments as old codes: known, replaced by two, or unknown."""
    code = X.resolve_category(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], {"HOUSEHOLD": ["HOME", "GARDEN"]})
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(code, "|").alias("codes"))


RESOLVED_CATEGORIES = """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment WHEN c_mktsegment = 'HOUSEHOLD' THEN 'HOME|GARDEN' ELSE '' END AS codes FROM customer"""


def category_labels(spark, sf_dir):
    """Suppliers with the name of their nation; a second pass drops nations outside the first two regions."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("category"))
    n = table(spark, sf_dir, "nation")
    few = n.filter("n_regionkey < 2").select(F.col("n_nationkey").cast("string").alias("category"), F.col("n_name").alias("label"))
    kept_all = X.with_labels(s, few).select("s_suppkey", "label", F.lit("all").alias("which"))
    return kept_all.unionByName(X.with_labels(s, few, keep_unknown=False).select("s_suppkey", "label", F.lit("known").alias("which")))


CATEGORY_LABELS = """SELECT s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) AS label, 'all' AS which FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 2
UNION ALL SELECT s_suppkey, n_name, 'known' FROM supplier JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 2"""


def first_seen_values(spark, sf_dir):
    """Sources in the order in which the documents show them."""
    return X.first_seen(table(spark, sf_dir, "documents"), "source", "doc_id")


FIRST_SEEN_VALUES = "SELECT source, min(doc_id) AS first_at FROM documents GROUP BY 1"


def redirected_orders(spark, sf_dir):
    """Customers with a negative balance redirect to the customer after them: one hop."""
    c = table(spark, sf_dir, "customer")
    redirects = c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("from_slug"), (F.col("c_custkey") + 1).alias("to_slug"))
    return readers.resolve_redirects(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("slug")), redirects)


REDIRECTED_ORDERS = "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN c_custkey + 1 ELSE o_custkey END AS slug FROM orders LEFT JOIN customer ON c_custkey = o_custkey"


def map_updates(spark, sf_dir):
    """Part names overwritten by the flag of their last line, of all that name them; types only where they are empty (small parts)."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 5, F.col("p_type")).otherwise("").alias("kind"))
    l = table(spark, sf_dir, "lineitem")
    u = l.select(F.col("l_partkey").alias("slug"), F.col("l_returnflag").alias("value"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("ord"))
    return readers.map_update(readers.map_update(t, u, "name", strict=True), u, "kind", only_if_empty=True)


MAP_UPDATES = """WITH u AS (SELECT l_partkey AS k, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) AS v FROM lineitem GROUP BY 1)
SELECT p_partkey AS slug, coalesce(v, p_name) AS name, CASE WHEN p_size > 5 THEN p_type ELSE coalesce(v, '') END AS kind FROM part LEFT JOIN u ON k = p_partkey"""


def unknown_translations(spark, sf_dir):
    """Translation keys (labelled documents, shifted by a fifth of the table) that no document bears."""
    docs = table(spark, sf_dir, "documents")
    shift = docs.agg(F.round(F.count("*") / 5).cast("long").alias("s"), F.lit(1).alias("one"))
    keys = table(spark, sf_dir, "labels").withColumn("one", F.lit(1)).join(F.broadcast(shift), "one").select((F.col("doc_id") + F.col("s")).alias("slug"))
    return readers.unknown_keys(keys, docs.select(F.col("doc_id").alias("slug")))


UNKNOWN_TRANSLATIONS = """WITH s AS (SELECT (count(*) / 5.0)::BIGINT AS s FROM documents), k AS (SELECT DISTINCT doc_id + s AS slug FROM labels, s)
SELECT slug FROM k WHERE slug NOT IN (SELECT doc_id FROM documents)"""


def title_definition(spark, sf_dir):
    """Definitions out of pages: the first words of an article, marked up as the term pages do it, after the page's own mark-up."""
    html = F.concat(F.col("html"), F.lit("\n<strong>한 줄 정의:</strong> "), F.substring_index("url", "/", -2), F.lit(" <i>"), F.col("page_id").cast("string"), F.lit("</i>\n"))
    return table(spark, sf_dir, "pages").select("page_id", E.definition(html).alias("definition"))


TITLE_DEFINITION = """SELECT page_id, trim(array_to_string(string_split(url, '/')[-2:], '/') || ' ' || page_id) AS definition FROM pages"""


def page_templates(spark, sf_dir):
    """A picture for a page: the first template with a keyword in the address, for pages with an article."""
    p = table(spark, sf_dir, "pages").withColumn("title", F.col("url"))
    keys = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("template"), F.col("n_regionkey").alias("tmpl_ord"), F.concat(F.lit("/"), F.col("n_nationkey").cast("string")).alias("keyword"), F.col("n_nationkey").alias("kw_ord"))
    return E.first_template(p, keys, F.col("title"), ["<article>"])


PAGE_TEMPLATES = """WITH h AS (SELECT page_id, n_regionkey, row_number() OVER (PARTITION BY page_id ORDER BY n_regionkey, n_nationkey) AS i
  FROM pages JOIN nation ON contains(lower(url), '/' || n_nationkey) WHERE contains(html, '<article>'))
SELECT page_id, 't' || n_regionkey AS template FROM h WHERE i = 1"""


def stripped_blocks(spark, sf_dir):
    """Advertisements go from pages that have no article."""
    html = E.strip_block(F.col("html"), '<div class="ad">.*?</div>', ["<article>"])
    return table(spark, sf_dir, "pages").select("page_id", F.length(html).alias("n"), F.sha2(html, 256).alias("sha256"))


STRIPPED_BLOCKS = """WITH s AS (SELECT page_id, CASE WHEN contains(html, '<article>') THEN html ELSE regexp_replace(html, '(?s)<div class="ad">.*?</div>', '', 'g') END AS h FROM pages)
SELECT page_id, length(h)::INT AS n, sha256(h) AS sha256 FROM s"""


def merged_links(spark, sf_dir):
    """Links of a page after those of the page before it, without its own address' last part."""
    slugs = E.page_slugs(E.hrefs(F.regexp_replace("html", r'href="/([^".]*)"', 'href="/$1.html"')))
    p = table(spark, sf_dir, "pages").select("page_id", F.array_sort(slugs).alias("found"))
    before = p.select((F.col("page_id") + 1).alias("page_id"), F.col("found").alias("existing"))
    both = p.join(before, "page_id", "left")
    return both.select("page_id", F.array_join(E.merged_related(F.col("existing"), F.col("found"), F.lit("the")), "|").alias("related"))


MERGED_LINKS = r"""WITH h AS (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, 'href="/([^".]*)"', 'href="/\1.html"', 'g'), 'href="([^"]*)"', 1)) AS h FROM pages
), s AS (SELECT DISTINCT page_id, regexp_extract(h, '(?:^|/)([^/]+)\.html(?:[?#].*)?$', 1) AS s FROM h), f AS (SELECT * FROM s WHERE s <> ''),
u AS (SELECT page_id, s, min(o) AS o FROM (SELECT page_id + 1 AS page_id, s, 0 AS o FROM f UNION ALL SELECT page_id, s, 1 FROM f) GROUP BY 1, 2)
SELECT p.page_id, coalesce(string_agg(s, '|' ORDER BY o, s) FILTER (s <> 'the'), '') AS related FROM pages p LEFT JOIN u ON u.page_id = p.page_id GROUP BY 1"""


def related_blocks(spark, sf_dir):
    """Each part's block of links to the first five parts, by number, that share an order with it; every target must exist."""
    parts = part_terms(spark, sf_dir).withColumn("title_ko", F.col("title_en"))
    place = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    e = co_bought(spark, sf_dir).repartition(line_tasks(spark, sf_dir), "src").withColumn("pos", place).filter("pos <= 5")
    slug = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string")).alias(c)
    return sinks.related_block(e.select(slug("src"), slug("dst"), "pos"), parts)


RELATED_BLOCKS = """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey),
f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS i FROM e)
SELECT 'part-' || src AS slug, '<div class="related-terms">' || string_agg('<a href="part-' || dst || '.html">' || p_name || '</a>', chr(10) ORDER BY dst) || '</div>' AS html
FROM f JOIN part ON p_partkey = dst WHERE i <= 5 GROUP BY src"""

_NAMES = [
    "match_korean", "korean_spans", "term_cards", "leaf_ranges", "browse_categories", "resolved_categories", "category_labels", "first_seen_values", "redirected_orders",
    "map_updates", "unknown_translations", "title_definition", "page_templates", "stripped_blocks", "merged_links", "related_blocks",
]
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {n: globals()[n.upper()] for n in _NAMES}
