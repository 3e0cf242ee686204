"""Data-quality rules over whole tables, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import graph as G
from termloom.operators import quality as Q
from termloom.plans.common import table
from termloom.plans.lookup import HANGUL, LATIN, hangul


def _slug(c: str):
    return F.concat(F.lit("part-"), F.col(c).cast("string"))


def related_lists(spark, sf_dir):
    """``(slug, term_ord, related)``: parts with lists out of all lines, by line number.

    Where at least half the lines of part p with number n were returned, p leads to part p + (n - 1) mod 6, so lists hold
    the part itself, repeats and, at the end of the table, parts that do not exist."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg((2 * F.count_if(F.col("l_returnflag") == "R") >= F.count("*")).alias("back")).filter("back")
    own = lines.groupBy(F.col("l_partkey").alias("k")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("ns"))
    p = table(spark, sf_dir, "part").join(own, F.col("k") == F.col("p_partkey"), "left")
    related = F.transform("ns", lambda n: F.concat(F.lit("part-"), (F.col("p_partkey") + (n - 1) % 6).cast("string")))
    return p.select(_slug("p_partkey").alias("slug"), F.col("p_partkey").cast("int").alias("term_ord"), related.alias("related"), "p_name", "p_type", "p_brand", "p_size")


_RELATED = """l AS MATERIALIZED (
  SELECT l_partkey AS src, l_partkey + (l_linenumber - 1) % 6 AS dst, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber) - 1 AS pos
  FROM (SELECT l_partkey, l_linenumber FROM lineitem GROUP BY ALL HAVING 2 * count(*) FILTER (l_returnflag = 'R') >= count(*))
), n AS (SELECT p_partkey AS k, count(l.src) AS n FROM part LEFT JOIN l ON src = p_partkey GROUP BY 1)"""


def _finding(rule, key, detail="NULL::VARCHAR", severity="error"):
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, {key} AS key, {detail} AS detail"


def dq_unknown_categories(spark, sf_dir):
    """Type and brand as categories; known are the types and the brands of parts of size 50."""
    p = table(spark, sf_dir, "part")
    known = p.select(F.col("p_type").alias("category")).unionByName(p.filter("p_size = 50").select(F.col("p_brand").alias("category"))).distinct()
    return Q.unknown_categories(p.select(_slug("p_partkey").alias("slug"), F.array("p_type", "p_brand").alias("categories")), known)


DQ_UNKNOWN_CATEGORIES = f"""{_finding('unknown category', "'part-' || p_partkey", 'p_brand')} FROM part
WHERE p_brand NOT IN (SELECT p_type FROM part UNION SELECT p_brand FROM part WHERE p_size = 50)"""


def dq_wrong_subcategory(spark, sf_dir):
    """Brands that a type allows are those of its parts of size 45 or more; the type ECONOMY has no list."""
    p = table(spark, sf_dir, "part")
    allowed = p.filter("p_size >= 45 and p_type <> 'ECONOMY'").select(F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"))
    return Q.wrong_subcategory(p.select(_slug("p_partkey").alias("slug"), F.array("p_type").alias("categories"), F.col("p_brand").alias("subcategory")), allowed)


DQ_WRONG_SUBCATEGORY = f"""WITH a AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size >= 45 AND p_type <> 'ECONOMY')
{_finding('wrong subcategory', "'part-' || p_partkey", 'p_brand')} FROM part p
WHERE p_type IN (SELECT p_type FROM a) AND NOT EXISTS (SELECT 1 FROM a WHERE a.p_type = p.p_type AND a.p_brand = p.p_brand)"""


def dq_broken_links(spark, sf_dir):
    return Q.broken_links(related_lists(spark, sf_dir))


DQ_BROKEN_LINKS = f"""WITH {_RELATED} {_finding('broken link', "'part-' || src", "'part-' || dst")} FROM l WHERE dst NOT IN (SELECT p_partkey FROM part)
UNION ALL {_finding('self link', "'part-' || src", "'part-' || dst")} FROM l WHERE dst = src"""


def dq_english_titles(spark, sf_dir):
    """Small parts without a title, then with the slug in its place, then with a price."""
    en = F.when(F.col("p_size") <= 5, "").when(F.col("p_size") <= 10, _slug("p_partkey")).when(F.col("p_size") <= 15, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    return Q.english_titles(table(spark, sf_dir, "part").select(_slug("p_partkey").alias("slug"), en.alias("title_en")))


DQ_ENGLISH_TITLES = """SELECT CASE WHEN p_size <= 5 THEN 'no english title' WHEN p_size <= 10 THEN 'slug as english title' ELSE 'english title without letters' END AS rule, 'error' AS severity,
  'part-' || p_partkey AS key, CASE WHEN p_size <= 5 THEN '' WHEN p_size <= 10 THEN 'part-' || p_partkey ELSE p_size::VARCHAR END AS detail FROM part WHERE p_size <= 15"""


def dq_korean_titles(spark, sf_dir):
    """Large parts with long Latin titles, others with short ones or Hangul."""
    long = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    ko = F.when(F.col("p_size") > 40, long).when(F.col("p_size") > 30, F.col("p_name")).otherwise(hangul(F.col("p_name")))
    return Q.korean_titles(table(spark, sf_dir, "part").select(_slug("p_partkey").alias("slug"), ko.alias("title_ko")))


DQ_KOREAN_TITLES = f"""WITH t AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_name || ' ' || p_type || ' ' || p_brand WHEN p_size > 30 THEN p_name ELSE translate(lower(p_name), '{LATIN}', '{HANGUL}') END AS ko FROM part)
{_finding('korean title missing', "'part-' || p_partkey", 'ko')} FROM t WHERE ko <> '' AND NOT regexp_matches(ko, '[가-힣]') AND NOT regexp_full_match(ko, '[A-Za-z0-9/\\-\\.\\+ ]{{1,20}}')"""


def dq_thin_entries(spark, sf_dir):
    """Parts with lists as related terms, their name as the definition, and brands of large ones as aliases."""
    t = related_lists(spark, sf_dir).select("slug", "related", F.col("p_name").alias("definition"), F.when(F.col("p_size") > 25, F.array("p_brand")).alias("aliases"))
    return Q.thin_entries(t)


DQ_THIN_ENTRIES = f"""WITH {_RELATED} {_finding('no related terms', "'part-' || k", severity='warning')} FROM n WHERE n = 0
UNION ALL {_finding('short definition', "'part-' || p_partkey", 'length(p_name)::VARCHAR', 'warning')} FROM part WHERE p_name <> '' AND length(p_name) < 20
UNION ALL {_finding('no aliases', "'part-' || p_partkey", severity='warning')} FROM part WHERE p_size <= 25 OR p_size IS NULL"""


def dq_edge_rules(spark, sf_dir):
    return Q.edge_rules(related_lists(spark, sf_dir))


DQ_EDGE_RULES = f"""WITH {_RELATED}, v AS MATERIALIZED (SELECT DISTINCT src, dst FROM l JOIN part ON p_partkey = dst WHERE src <> dst)
{_finding('no related terms', "'part-' || k")} FROM n WHERE n = 0
UNION ALL {_finding('too many related terms', "'part-' || k", 'n::VARCHAR', 'warning')} FROM n WHERE n > 5
UNION ALL {_finding('repeated related term', "'part-' || src", "'part-' || dst")} FROM l GROUP BY src, dst HAVING count(*) > 1
UNION ALL {_finding('self link', "'part-' || src")} FROM l WHERE src = dst GROUP BY src
UNION ALL {_finding('unknown related term', "'part-' || src", "'part-' || dst")} FROM (SELECT DISTINCT src, dst FROM l) x WHERE dst NOT IN (SELECT p_partkey FROM part)
UNION ALL {_finding('unanswered link', "'part-' || src", "'part-' || dst")} FROM (FROM v ANTI JOIN (SELECT DISTINCT dst AS src, src AS dst FROM l) USING (src, dst))"""


def dq_pages(spark, sf_dir):
    """Documents as terms against pages: lost, orphaned, or without an article or a list."""
    terms = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).cast("string").alias("slug"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("slug"), "html")
    return Q.page_rules(terms, pages, {"no article": "<article>", "no advertisement": 'class="ad"'})


DQ_PAGES = f"""WITH t AS (SELECT doc_id * 2 AS s FROM documents)
{_finding('not in pages', 's::VARCHAR')} FROM (SELECT DISTINCT s FROM t) x WHERE s NOT IN (SELECT page_id FROM pages)
UNION ALL {_finding('not in terms', 'page_id::VARCHAR')} FROM pages WHERE page_id NOT IN (SELECT s FROM t)
UNION ALL {_finding('no article', 'page_id::VARCHAR', severity='warning')} FROM pages WHERE page_id IN (SELECT s FROM t) AND NOT contains(html, '<article>')
UNION ALL {_finding('no advertisement', 'page_id::VARCHAR', severity='warning')} FROM pages WHERE page_id IN (SELECT s FROM t) AND NOT contains(html, 'class="ad"')"""


def dq_slug_rules(spark, sf_dir):
    """Part names, trimmed and blank for the smallest, as slugs; pages are the names that customers' segments start."""
    p = table(spark, sf_dir, "part")
    slug = F.when(F.col("p_size") > 1, F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    pages = p.filter("p_retailprice > 1000").select(F.col("p_name").alias("slug")).distinct()
    return Q.slug_rules(p.select(slug.alias("slug")), pages)


DQ_SLUG_RULES = f"""WITH t AS (SELECT CASE WHEN p_size > 1 THEN trim(p_name) ELSE '' END AS s FROM part), g AS (SELECT s, count(*) AS n FROM t GROUP BY 1)
{_finding('blank slug', 's', 'n::VARCHAR')} FROM g WHERE s = ''
UNION ALL {_finding('duplicate slug', 's', 'n::VARCHAR')} FROM g WHERE s <> '' AND n > 1
UNION ALL {_finding('no page', 's')} FROM g WHERE s <> '' AND s NOT IN (SELECT p_name FROM part WHERE p_retailprice > 1000)"""


def dq_category_overlap(spark, sf_dir):
    """Names that parts of one type or brand share, two categories each: a finding for each, with a digest of all its parts."""
    p = table(spark, sf_dir, "part").select(_slug("p_partkey").alias("slug"), F.col("p_name").alias("title_ko"), F.array("p_type", "p_brand").alias("categories"))
    return Q.same_title(p, every=True).select("rule", "key", F.sha2("detail", 256).alias("slugs_sha256"))


DQ_CATEGORY_OVERLAP = """WITH c AS (SELECT p_name, p_partkey, unnest([p_type, p_brand]) AS c FROM part), t AS (SELECT DISTINCT p_name FROM (SELECT p_name FROM c GROUP BY p_name, c HAVING count(DISTINCT p_partkey) > 1))
SELECT 'same title in category' AS rule, p_name AS key, sha256(string_agg('part-' || p_partkey, ', ' ORDER BY 'part-' || p_partkey)) AS slugs_sha256 FROM part JOIN t USING (p_name) GROUP BY p_name"""


def batch_tallies(spark, sf_dir):
    from termloom.plans.pages import batch_merge

    return Q.tallies(batch_merge(spark, sf_dir))


from termloom.plans.pages import BATCH_MERGE  # noqa: E402

BATCH_TALLIES = f"SELECT fate, count(*) AS n FROM ({BATCH_MERGE}) GROUP BY 1"


def graph_terms(spark, sf_dir):
    """Parts as terms with lists of links: type and brand as categories.  Kept, as each use would go through all lines again."""
    from termloom.sources.shared import kept

    return kept(related_lists(spark, sf_dir).select(
        "slug", F.lit("").alias("title_ko"), F.col("p_name").alias("title_en"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("definition"),
        F.array("p_type", "p_brand").alias("categories"), F.col("p_brand").alias("subcategory"), "related", "term_ord"))


def links_filled(spark, sf_dir):
    """Parts with under three links take their best partners of the same type or brand."""
    return G.fill(graph_terms(spark, sf_dir)).select("src", "dst", F.col("pos").cast("long").alias("pos"))


_TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9가-힣]+', ' ', 'g'), '\\s+'), lambda t: length(t) >= 2))"
_OWN = f"""{_RELATED}, own AS MATERIALIZED (
  SELECT src, dst, min(pos) AS pos FROM l JOIN part ON p_partkey = dst WHERE src <> dst GROUP BY 1, 2
)"""
_SCORED = f"""t AS MATERIALIZED (
  SELECT p_partkey AS k, 'part-' || p_partkey AS slug, p_type, p_brand, {_TOK.format("'part-' || p_partkey || ' ' || p_name")} AS title, {_TOK.format("p_name || ' ' || p_type || ' ' || p_brand")} AS def FROM part
), s AS MATERIALIZED (
  SELECT a.k AS src, b.k AS dst, 'part-' || b.k AS name, 100 * ((a.p_type = b.p_type)::INT + (a.p_brand = b.p_brand)::INT) + 20 * len(list_intersect(a.title, b.title)) + 2 * len(list_intersect(a.def, b.def))
    + CASE WHEN a.p_type = b.p_type AND a.p_brand = b.p_brand THEN 15 ELSE 0 END AS score
  FROM t a JOIN t b ON (a.p_type = b.p_type OR a.p_brand = b.p_brand) AND a.k <> b.k
), short AS (SELECT p_partkey AS src, count(own.src) AS n FROM part LEFT JOIN own ON own.src = p_partkey GROUP BY 1 HAVING count(own.src) < 3
), r AS (
  SELECT src, dst, n, row_number() OVER (PARTITION BY src ORDER BY score DESC, name) AS i FROM s JOIN short USING (src) ANTI JOIN own USING (src, dst)
), filled AS MATERIALIZED (SELECT src, dst, pos FROM own UNION ALL SELECT src, dst, i + 1000000 FROM r WHERE i <= 5 - n)"""
LINKS_FILLED = f"WITH {_OWN}, {_SCORED} SELECT 'part-' || src AS src, 'part-' || dst AS dst, pos FROM filled"


def _lists(links):
    """All parts' lists as one row; place k + 1 of ``lists`` is the list of part k, as places of other lists."""
    return f"""SELECT 0 AS t, list(coalesce(ls, []) ORDER BY k) AS lists FROM (
    SELECT p_partkey AS k, list(dst + 1 ORDER BY pos) FILTER (dst IS NOT NULL) AS ls FROM part LEFT JOIN {links} ON src = p_partkey GROUP BY 1)"""


#: One turn: partners that lack the term take it up where they have room; it drops those that have none.
_ANSWER = """list_transform(lists, lambda l, i: CASE
    WHEN i = t + 1 THEN list_filter(l, lambda p: list_contains(lists[p], i) OR len(lists[p]) < 5)
    WHEN list_contains(lists[t + 1], i) AND NOT list_contains(l, t + 1) AND len(l) < 5 THEN list_append(l, t + 1) ELSE l END)"""
_TURNS = "(SELECT count(*) FROM part)"
#: Parts are numbered from 0 in input order, so turn t + 1 is that of part t.
LINKS_ANSWERED = f"""WITH RECURSIVE {_OWN}, turn AS ({_lists('own')}
  UNION ALL SELECT t + 1, {_ANSWER} FROM turn WHERE t < {_TURNS}
), last AS (SELECT lists FROM turn WHERE t = {_TURNS})
SELECT 'part-' || p_partkey AS src, 'part-' || (unnest(lists[p_partkey + 1]) - 1) AS dst FROM part, last"""

LINKS_RECONCILED = f"""WITH RECURSIVE {_OWN}, {_SCORED}, turn AS ({_lists('filled')}
  UNION ALL SELECT t + 1, {_ANSWER} FROM turn WHERE t < {_TURNS}
), best AS MATERIALIZED (SELECT src, list(dst + 1 ORDER BY score DESC, name) AS c FROM s GROUP BY 1
), again AS (SELECT 0 AS t, lists FROM turn WHERE t = {_TURNS}
  UNION ALL SELECT t + 1, list_transform(lists, lambda l, i: CASE
    WHEN i = t + 1 THEN list_concat(l, picks) WHEN list_contains(picks, i) THEN list_append(l, t + 1) ELSE l END)
  FROM (SELECT t, lists, CASE WHEN len(lists[t + 1]) < 3
    THEN list_filter(coalesce(c, []), lambda x: len(lists[x]) < 5 AND NOT list_contains(lists[t + 1], x))[:3 - len(lists[t + 1])] ELSE [] END AS picks
    FROM again LEFT JOIN best ON best.src = t WHERE t < {_TURNS})
), last AS (SELECT lists FROM again WHERE t = {_TURNS})
SELECT 'part-' || k AS src, 'part-' || (l[i] - 1) AS dst, i - 1 AS pos FROM (
  SELECT p_partkey AS k, lists[p_partkey + 1] AS l, unnest(generate_series(1, least(5, len(lists[p_partkey + 1])))) AS i FROM part, last)"""


def links_answered(spark, sf_dir):
    """The answering pass over the lists as they are, without filling."""
    t = graph_terms(spark, sf_dir)
    return G.reciprocated(t, G.clean_edges(t)).select("src", "dst")


def links_reconciled(spark, sf_dir):
    """Filled, answered and refilled lists of at most five."""
    from termloom.operators.partners import profiles
    from termloom.sources.shared import kept

    t = graph_terms(spark, sf_dir)
    known = kept(profiles(t))
    return G.reconcile(t, kept(G.fill(t, known)), known).select("src", "dst", F.col("pos").cast("long").alias("pos"))


_NAMES = [
    "dq_unknown_categories", "dq_wrong_subcategory", "dq_broken_links", "dq_english_titles", "dq_korean_titles", "dq_thin_entries", "dq_edge_rules", "dq_pages", "dq_slug_rules",
    "dq_category_overlap", "batch_tallies", "links_filled", "links_answered", "links_reconciled",
]
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {n: globals()[n.upper()] for n in _NAMES}
