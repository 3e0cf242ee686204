"""Search, taxonomy, graph and roadmap queries over the part catalogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators import graph as G
from termloom.operators import roadmap as R
from termloom.operators import search as S
from termloom.operators import taxonomy as X
from termloom.plans.common import RETURNED_PARTS, co_bought, line_tasks, part_terms, returned_parts, table
from termloom.sources.shared import kept


def _search_word(spark, sf_dir):
    """The first word of the first part's name: a query that the table itself holds."""
    return table(spark, sf_dir, "part").orderBy("p_partkey").limit(1).select(F.lower(F.substring_index("p_name", " ", 1)).alias("q")).first()["q"]


def search_rank(spark, sf_dir):
    hits = S.browse(part_terms(spark, sf_dir), _search_word(spark, sf_dir))
    return hits.select("slug", F.col("rank").alias("tier"), "position")


_TERMS = """terms AS (
  SELECT 'part-' || p_partkey AS slug, p_partkey AS term_ord, p_name AS title_en, p_type, p_brand, p_name || ' ' || p_type AS definition FROM part
)"""
SEARCH_RANK = f"""WITH {_TERMS}, q AS (SELECT lower(split_part(p_name, ' ', 1)) AS q FROM part ORDER BY p_partkey LIMIT 1), r AS (
  SELECT slug, term_ord, q, [lower(title_en), lower(p_type), lower(p_brand)] AS f FROM terms, q
), t AS (
  SELECT slug, term_ord, CASE WHEN list_contains(f, q) THEN 0
    WHEN starts_with(f[1], q) OR starts_with(f[2], q) OR starts_with(f[3], q) THEN 1
    WHEN contains(f[1], q) OR contains(f[2], q) OR contains(f[3], q) THEN 2 END AS tier FROM r
) SELECT slug, tier, row_number() OVER (ORDER BY tier, term_ord) AS position FROM t WHERE tier IS NOT NULL"""


def contains_filter(spark, sf_dir):
    return S.contains_filter(part_terms(spark, sf_dir), _search_word(spark, sf_dir)).select("slug", "title_en")


CONTAINS_FILTER = f"""WITH {_TERMS}, q AS (SELECT lower(split_part(p_name, ' ', 1)) AS q FROM part ORDER BY p_partkey LIMIT 1)
SELECT slug, title_en FROM terms, q WHERE contains(lower(title_en), q)"""


def near_titles(spark, sf_dir):
    return S.near_titles(part_terms(spark, sf_dir), _search_word(spark, sf_dir), 0.6).select("slug", F.round("score", 6).alias("score"))


NEAR_TITLES = f"""WITH {_TERMS}, q AS (SELECT lower(split_part(p_name, ' ', 1)) AS q FROM part ORDER BY p_partkey LIMIT 1), n AS (
  SELECT slug, q, unnest([title_en, p_type, p_brand]) AS name FROM terms, q
) SELECT slug, round(min(levenshtein(lower(name), q) / greatest(length(name), length(q))), 6) AS score
FROM n GROUP BY slug HAVING min(levenshtein(lower(name), q) / greatest(length(name), length(q))) <= 0.6"""


def header_search(spark, sf_dir):
    """Exact then near hits for the first part's whole name; the first eight."""
    q = table(spark, sf_dir, "part").orderBy("p_partkey").limit(1).select("p_name").first()["p_name"]
    return S.header_search(part_terms(spark, sf_dir), q).select("slug", "tier", F.round("score", 6).alias("score"))


HEADER_SEARCH = f"""WITH {_TERMS}, q AS (SELECT lower(p_name) AS q FROM part ORDER BY p_partkey LIMIT 1), n AS (
  SELECT slug, term_ord, q, unnest([title_en, p_type, p_brand]) AS name FROM terms, q
), s AS (
  SELECT slug, min(term_ord) AS term_ord, min(levenshtein(lower(name), q) / greatest(length(name), length(q))) AS score, bool_or(lower(name) = q) AS exact FROM n GROUP BY slug
) SELECT slug, CASE WHEN exact THEN 0 ELSE 1 END AS tier, round(CASE WHEN exact THEN 0.0 ELSE score END, 6) AS score
FROM s WHERE exact OR score <= 0.4 ORDER BY 2, 3, term_ord LIMIT 8"""


def category_counts(spark, sf_dir):
    return X.category_counts(part_terms(spark, sf_dir))


CATEGORY_COUNTS = "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1"


def primary_counts(spark, sf_dir):
    return X.primary_counts(_doc_terms(spark, sf_dir))


PRIMARY_COUNTS = "SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1"


def _doc_terms(spark, sf_dir):
    """Documents as terms of two categories: language, then source; source is the subcategory."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("slug"), F.col("doc_id").alias("term_ord"), F.col("source").alias("subcategory"), F.array("lang", "source").alias("categories")
    )


def taxonomy_rollup(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "english").otherwise("other").alias("grp"), F.col("lang").alias("category")).distinct()
    return X.rollup(_doc_terms(spark, sf_dir), groups)


_PLACED = """placed AS (
  SELECT lang AS category, coalesce(nullif(source, ''), '관련 용어') AS subcategory, doc_id AS slug FROM documents
  UNION ALL SELECT source, '관련 용어', doc_id FROM documents
)"""
TAXONOMY_ROLLUP = f"""WITH {_PLACED}, g AS (
  SELECT p.*, CASE WHEN d.lang IS NULL THEN NULL WHEN d.lang = 'en' THEN 'english' ELSE 'other' END AS grp
  FROM placed p LEFT JOIN (SELECT DISTINCT lang FROM documents) d ON d.lang = p.category
) SELECT grp, category, subcategory, grouping(grp, category, subcategory)::INT AS level, count(*) AS n, count(DISTINCT slug) AS n_terms
FROM g GROUP BY ROLLUP (grp, category, subcategory)"""


def featured_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.col("n_name").alias("category"), F.col("n_nationkey").alias("ord"))
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("category")).distinct().select("category", F.crc32(F.col("category").cast("binary")).cast("int").alias("ord"))
    return X.featured_counts(part_terms(spark, sf_dir), types.unionByName(lines)).select("category", "n")


FEATURED_COUNTS = """SELECT f.category, count(p.p_partkey) AS n FROM (SELECT DISTINCT p_type AS category FROM part UNION ALL SELECT n_name FROM nation) f
LEFT JOIN part p ON p.p_type = f.category GROUP BY 1"""


def subcategory_order(spark, sf_dir):
    """Sources of a language: those listed, numbers below ten, first, then the others by name."""
    docs = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    order = docs.select(F.col("lang").alias("category"), F.col("source").alias("subcategory"), number.alias("pos")).filter("pos < 10").distinct()
    return X.ordered_subcategories(_doc_terms(spark, sf_dir), order)


SUBCATEGORY_ORDER = f"""WITH {_PLACED}, f AS (
  SELECT p.category, p.subcategory, count(*) AS n FROM placed p GROUP BY ALL
), o AS (
  SELECT DISTINCT lang AS category, source AS subcategory, regexp_extract(source, '(\\d+)$', 1)::INT AS pos FROM documents
  WHERE regexp_extract(source, '(\\d+)$', 1)::INT < 10
), r AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.category ORDER BY pos IS NULL, pos, f.subcategory) AS place
  FROM f LEFT JOIN o ON o.category = f.category AND o.subcategory = f.subcategory
) SELECT category, subcategory, n, place::INT AS place, place = 1 AS opens FROM r"""


def subcategory_pages(spark, sf_dir):
    return X.first_page(_doc_terms(spark, sf_dir))


SUBCATEGORY_PAGES = f"""WITH {_PLACED}, r AS (
  SELECT *, row_number() OVER (PARTITION BY category, subcategory ORDER BY slug, slug::VARCHAR) AS place, count(*) OVER (PARTITION BY category, subcategory) AS n FROM placed
) SELECT category, subcategory, slug::VARCHAR AS slug, place::INT AS place, greatest(n - 40, 0) AS more FROM r WHERE place <= 40"""


def related_topk(spark, sf_dir):
    """The best five of each part among those of its type."""
    return G.best_pairs(part_terms(spark, sf_dir)).select("src", "dst", "score", "rank")


def _tok(x):
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9가-힣]+', ' ', 'g'), '\\s+'), lambda t: length(t) >= 2))"


_PAIRS = f"""{_TERMS}, t AS (
  SELECT slug, p_type, {_tok("slug || ' ' || ' ' || title_en")} AS title, {_tok("definition")} AS def FROM terms
), pairs AS (
  SELECT a.slug AS src, b.slug AS dst, 115 + 20 * len(list_intersect(a.title, b.title)) + 2 * len(list_intersect(a.def, b.def)) AS score
  FROM t a JOIN t b ON a.p_type = b.p_type AND a.slug <> b.slug
), top AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM pairs
)"""
RELATED_TOPK = f"WITH {_PAIRS} SELECT src, dst, score::INT AS score, rank::INT AS rank FROM top WHERE rank <= 5"


def related_mutual(spark, sf_dir):
    best = kept(G.best_pairs(part_terms(spark, sf_dir)))
    return G.mutual_top(best, G.tasks_over(best)).select("src", "dst", "score", "rank")


RELATED_MUTUAL = f"""WITH {_PAIRS} SELECT a.src, a.dst, a.score::INT AS score, a.rank::INT AS rank
FROM top a JOIN top b ON a.src = b.dst AND a.dst = b.src WHERE a.rank <= 5 AND b.rank <= 5"""


def edge_symmetry(spark, sf_dir):
    """A part leads to another where more of it was bought in one order: links that no order answers."""
    n = line_tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition(n, "l_orderkey")
    a, b = lines.alias("a"), lines.alias("b")
    led = a.join(b, "l_orderkey").filter("a.l_partkey <> b.l_partkey and a.l_quantity > b.l_quantity")
    return G.asymmetric(led.select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")), n)


EDGES = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"
EDGE_SYMMETRY = """WITH e AS MATERIALIZED (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey AND a.l_quantity > b.l_quantity
) SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src)"""


def edge_dedup(spark, sf_dir):
    e = co_bought(spark, sf_dir).withColumn("src_ord", F.col("src") % 100).withColumn("pos", F.col("dst") % 10)
    return G.undirected(e, tasks=line_tasks(spark, sf_dir))


EDGE_DEDUP = f"""WITH {EDGES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src % 100, dst % 10, src, dst) AS i FROM edges
) SELECT src, dst FROM r WHERE i = 1"""


def _graph(spark, sf_dir):
    """Parts in their brands, and the links inside: what follows looks at no others."""
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("slug"), F.col("p_partkey").alias("term_ord"), F.col("p_brand").alias("grp"))
    return nodes, co_bought(spark, sf_dir, nodes.select(F.col("slug").alias("l_partkey"), "grp")).withColumn("pos", F.col("dst"))


def indegree(spark, sf_dir):
    return G.in_degree(*_graph(spark, sf_dir)).select("slug", "grp", "inbound")


_INNER = f"""{EDGES}, deg AS (
  SELECT p.p_partkey AS slug, p.p_brand AS grp, count(e.src) AS inbound
  FROM part p LEFT JOIN (SELECT e.* FROM edges e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE a.p_brand = b.p_brand) e ON e.dst = p.p_partkey
  GROUP BY 1, 2
), lev AS (
  SELECT *, CASE WHEN inbound = 0 THEN 3 WHEN place <= ceil(n / 3.0) THEN 1 WHEN place <= ceil(2.0 * n / 3) THEN 2 ELSE 3 END AS difficulty
  FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY inbound DESC, slug) AS place, count(*) OVER (PARTITION BY grp) AS n FROM deg)
)"""
INDEGREE = f"WITH {_INNER} SELECT slug, grp, inbound FROM deg"


def difficulty_tertiles(spark, sf_dir):
    return R.difficulty(*_graph(spark, sf_dir)).select("slug", "grp", "inbound", "difficulty")


DIFFICULTY_TERTILES = f"WITH {_INNER} SELECT slug, grp, inbound, difficulty::INT AS difficulty FROM lev"


def prerequisites(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    edges = kept(edges)
    return R.prerequisites(R.difficulty(nodes, edges), edges)


PREREQUISITES = f"""WITH {_INNER}, r AS (
  SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) AS pos
  FROM edges e JOIN lev a ON a.slug = e.src JOIN lev b ON b.slug = e.dst WHERE a.grp = b.grp AND b.difficulty < a.difficulty
) SELECT src, dst, pos::INT AS pos FROM r WHERE pos <= 3"""


def learning_order(spark, sf_dir):
    return R.learning_order(R.difficulty(*_graph(spark, sf_dir))).select("slug", "grp", "place")


LEARNING_ORDER = f"WITH {_INNER} SELECT slug, grp, row_number() OVER (PARTITION BY grp ORDER BY difficulty, slug)::INT AS place FROM lev"


def learning_paths(spark, sf_dir):
    """Each part rests on the two parts of its brand, by number, that share an order with it: circles and chains of any difficulty."""
    nodes, edges = _graph(spark, sf_dir)
    edges = kept(edges)
    levels = kept(R.difficulty(nodes, edges))
    place = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    needs = G.inner_edges(levels, edges).withColumn("i", place).filter("i <= 2")
    return R.topological_order(levels, needs).select("grp", "slug", F.col("place").cast("long").alias("place"))


LEARNING_PATHS = f"""WITH RECURSIVE {_INNER}, lvl AS MATERIALIZED (SELECT slug, grp, difficulty FROM lev), need AS MATERIALIZED (
  SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) AS i FROM edges e JOIN lvl a ON a.slug = e.src JOIN lvl b ON b.slug = e.dst WHERE a.grp = b.grp) WHERE i <= 2
), reach AS (SELECT slug AS src, slug AS dst FROM lvl UNION SELECT r.src, n.dst FROM reach r JOIN need n ON n.src = r.dst
), root AS MATERIALIZED (SELECT a.src AS slug, min(a.dst) AS root FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1
), hard AS MATERIALIZED (SELECT r.src AS slug, max(l.difficulty) AS hard FROM reach r JOIN lvl l ON l.slug = r.dst GROUP BY 1
), down AS MATERIALIZED (
  SELECT DISTINCT a.root AS src, b.root AS dst FROM need n JOIN root a ON a.slug = n.src JOIN root b ON b.slug = n.dst JOIN hard h ON h.slug = n.src JOIN hard k ON k.slug = n.dst
  WHERE a.root <> b.root AND h.hard = k.hard
), chain AS (SELECT DISTINCT root, 0 AS n FROM root UNION SELECT d.src, c.n + 1 FROM chain c JOIN down d ON d.dst = c.root
), deep AS (SELECT root, max(n) AS depth FROM chain GROUP BY 1
) SELECT grp, slug, row_number() OVER (PARTITION BY grp ORDER BY hard, depth, difficulty, slug) AS place FROM lvl JOIN root USING (slug) JOIN hard USING (slug) JOIN deep USING (root)"""


def progress_pct(spark, sf_dir):
    """Parts that mostly came back, by brand."""
    nodes, _ = _graph(spark, sf_dir)
    return R.progress(nodes, returned_parts(spark, sf_dir).withColumnRenamed("l_partkey", "slug"))


PROGRESS_PCT = f"""SELECT p_brand AS grp, count(d.k) AS n_done, count(*) AS n, floor(100.0 * count(d.k) / count(*) + 0.5)::BIGINT AS pct
FROM part LEFT JOIN (SELECT l_partkey AS k FROM {RETURNED_PARTS}) d ON d.k = p_partkey GROUP BY 1"""


def largest_subgraph(spark, sf_dir):
    return G.largest_subgraph(co_bought(spark, sf_dir)).select("src", "dst")


LARGEST_SUBGRAPH = f"""WITH {EDGES}, top AS (
  SELECT slug FROM (SELECT src AS slug FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY count(*) DESC, slug LIMIT 20
) SELECT src, dst FROM edges WHERE src IN (FROM top) AND dst IN (FROM top)"""


def section_starts(spark, sf_dir):
    """Nations in order of key: where the region changes."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("category"), F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("grp"))
    return X.section_starts(n)


SECTION_STARTS = """SELECT n_name AS category, n_nationkey AS ord, n_regionkey AS grp,
  n_regionkey IS DISTINCT FROM lag(n_regionkey) OVER (ORDER BY n_nationkey) AS new_section FROM nation"""


def newest_items(spark, sf_dir):
    """The newest thirty orders, as a feed lists its items."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


NEWEST_ITEMS = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30"

def circular_layout(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return G.circular_layout(nodes).select("slug", "grp", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


CIRCULAR_LAYOUT = """WITH p AS (SELECT p_partkey AS slug, p_brand AS grp, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT slug, grp, round(100 * cos(2 * pi() * i / n - pi() / 2), 4) + 0.0 AS x, round(100 * sin(2 * pi() * i / n - pi() / 2), 4) + 0.0 AS y FROM p"""


def category_order(spark, sf_dir):
    """Nations by region and key, against their order by key alone."""
    from termloom.operators.quality import order_matches_groups

    n = table(spark, sf_dir, "nation")
    groups = n.select(F.col("n_regionkey").alias("grp_ord"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("category"))
    return order_matches_groups(groups, n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("category")))


CATEGORY_ORDER = """SELECT n_name AS category, n_nationkey AS pos, g::INT AS group_pos FROM (
  SELECT *, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS g FROM nation) WHERE n_nationkey IS DISTINCT FROM g"""


def facets(spark, sf_dir):
    """Parts as matches: hidden ones, that mostly came back, out, an easy or unknown level, a word in the title, one category."""
    from termloom.operators.matching import facet_filter

    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("slug"), F.lit("").alias("title_ko"), F.col("p_name").alias("title_en"), F.array("p_type").alias("categories"),
        F.when(F.col("p_size") > 3, F.col("p_size") % 4).alias("difficulty"))
    hidden = returned_parts(spark, sf_dir).withColumnRenamed("l_partkey", "slug")
    kind = table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return facet_filter(p, hidden, "r", [1, 2], kind, english_only=True).select("slug", "title_en", "difficulty")


FACETS = f"""SELECT p_partkey AS slug, p_name AS title_en, CASE WHEN p_size > 3 THEN p_size % 4 END::INT AS difficulty FROM part
WHERE p_partkey NOT IN {RETURNED_PARTS} AND contains(lower(p_name), 'r')
  AND (p_size <= 3 OR p_size IS NULL OR p_size % 4 IN (1, 2)) AND p_type = (SELECT min(p_type) FROM part)"""


def near_words(spark, sf_dir):
    """Words of the documents one edit away from words of the benchmark."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    keys = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("key")).distinct()
    return S.near_words(words, keys).select("word", "key", F.round("score", 6).alias("score"), "place")


NEAR_WORDS = """WITH w AS MATERIALIZED (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents),
k AS MATERIALIZED (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS key FROM benchmark),
p AS (SELECT word, key, levenshtein(word, key) AS e FROM w JOIN k ON length(word) >= 5 AND length(key) >= 4 AND abs(length(word) - length(key)) <= 1
  WHERE word NOT IN (SELECT key FROM k) AND levenshtein(word, key) <= 1),
r AS (SELECT word, key, e / greatest(length(word), length(key)) AS score FROM p)
SELECT word, key, round(score, 6) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score, key) AS place FROM r WHERE score <= 0.2) WHERE place <= 3"""

def named_terms(spark, sf_dir):
    """Parts, suppliers and customers as terms: a part's type and brand as aliases, a name's number as the alias of the others."""
    p = part_terms(spark, sf_dir).select("slug", "title_ko", "title_en", "aliases", F.col("term_ord").cast("long").alias("term_ord"))
    for t, key, name, base in (("supplier", "s_suppkey", "s_name", 1 << 40), ("customer", "c_custkey", "c_name", 1 << 41)):
        p = p.unionByName(table(spark, sf_dir, t).select(
            F.concat(F.lit(t + "-"), F.col(key).cast("string")).alias("slug"), F.col(name).alias("title_ko"), F.lit(t).alias("title_en"),
            F.array(F.col(key).cast("string")).alias("aliases"), (F.col(key) + base).cast("long").alias("term_ord")))
    return p


def fuzzy_search(spark, sf_dir):
    """Every word of the benchmark, and every part's name cut by its last letter, searched in all names at once."""
    from termloom.operators import fuzzy

    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("query"))
    cut = table(spark, sf_dir, "part").select(F.expr("left(p_name, length(p_name) - 1)").alias("query"))
    found = fuzzy.search_many(words.unionByName(cut), named_terms(spark, sf_dir))
    return found.select("query", "slug", "tier", F.round("score", 6).alias("score"), "place")


FUZZY_SEARCH = """WITH q AS (
  SELECT DISTINCT q FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS q FROM benchmark UNION ALL SELECT lower(trim(left(p_name, length(p_name) - 1))) FROM part) WHERE q <> ''
), f AS (
  SELECT slug, term_ord, u.f AS field, lower(trim(u.n)) AS name FROM (
    SELECT 'part-' || p_partkey AS slug, p_partkey AS term_ord, unnest([{'f': 'title_en', 'n': p_name}, {'f': 'alias', 'n': p_type}, {'f': 'alias', 'n': p_brand}]) AS u FROM part
    UNION ALL SELECT 'supplier-' || s_suppkey, s_suppkey + (1::BIGINT << 40), unnest([{'f': 'title_ko', 'n': s_name}, {'f': 'title_en', 'n': 'supplier'}, {'f': 'alias', 'n': s_suppkey::VARCHAR}]) FROM supplier
    UNION ALL SELECT 'customer-' || c_custkey, c_custkey + (1::BIGINT << 41), unnest([{'f': 'title_ko', 'n': c_name}, {'f': 'title_en', 'n': 'customer'}, {'f': 'alias', 'n': c_custkey::VARCHAR}]) FROM customer
  ) WHERE trim(u.n) <> ''
), m AS MATERIALIZED (
  SELECT q, name, levenshtein(q, name) / greatest(length(q), length(name)) AS share
  FROM q JOIN (SELECT DISTINCT name FROM f) n ON abs(length(q) - length(name)) <= 0.4 * greatest(length(q), length(name))
  WHERE levenshtein(q, name) / greatest(length(q), length(name)) <= 0.4
), p AS (
  SELECT q, slug, field, min(share) AS share, min(term_ord) AS term_ord FROM m JOIN f USING (name) GROUP BY ALL
), h AS (
  SELECT q, slug, sum(round(CASE field WHEN 'title_ko' THEN 0.55 WHEN 'title_en' THEN 0.3 ELSE 0.15 END::DOUBLE * (1 - share), 9)::DECIMAL(12,9)) AS score,
    min(CASE WHEN share = 0 THEN 0 ELSE 1 END) AS tier, min(term_ord) AS term_ord FROM p GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, CASE WHEN tier = 1 THEN -score END, term_ord, slug) AS place FROM h
) SELECT q AS query, slug, tier, round(score::DOUBLE, 6) AS score, place::INT AS place FROM r WHERE place <= 8"""


_NAMES = [
    "fuzzy_search", "search_rank", "contains_filter", "near_titles", "header_search", "category_counts", "primary_counts", "taxonomy_rollup", "featured_counts",
    "subcategory_order", "subcategory_pages", "related_topk", "related_mutual", "edge_symmetry", "edge_dedup", "indegree", "difficulty_tertiles",
    "prerequisites", "learning_order", "learning_paths", "progress_pct", "largest_subgraph", "section_starts", "newest_items",
    "circular_layout", "category_order", "facets", "near_words",
]
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {n: globals()[n.upper()] for n in _NAMES}
