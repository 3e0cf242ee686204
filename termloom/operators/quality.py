"""Data-quality rules.  Each gives findings ``(rule, severity, key, detail)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions.text import spelling_key

SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
SAMPLES = 15


def finding(rows: DataFrame, rule: str, key: Column, detail: Column | None = None, severity: str = "error") -> DataFrame:
    detail = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.alias("detail"))


def missing_fields(terms: DataFrame, fields: list[str], key: str = "slug") -> DataFrame:
    """One finding for each required field that is null, empty or an empty array."""
    def empty(c):
        kind = terms.schema[c].dataType.typeName()
        return F.col(c).isNull() | ((F.size(c) == 0) if kind == "array" else (F.col(c).cast("string") == ""))

    wrong = F.filter(F.array(*[F.when(empty(c), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return finding(terms.select(key, F.explode(wrong).alias("field")), "missing field", F.col(key), F.col("field"))


def bad_slugs(terms: DataFrame) -> DataFrame:
    return finding(terms.filter(~F.coalesce(F.col("slug"), F.lit("")).rlike(SLUG)), "slug format", F.col("slug"))


def slug_rules(terms: DataFrame, pages: DataFrame) -> DataFrame:
    """Slugs, trimmed: blank ones, ones borne by several terms, and ones without a page."""
    t = terms.select(F.trim(F.coalesce(F.col("slug"), F.lit(""))).alias("slug"))
    per = t.groupBy("slug").agg(F.count("*").alias("n"))
    blank = finding(per.filter("slug = ''"), "blank slug", F.col("slug"), F.col("n"))
    several = finding(per.filter("slug <> '' and n > 1"), "duplicate slug", F.col("slug"), F.col("n"))
    lost = finding(per.filter("slug <> ''").join(pages.select("slug"), "slug", "left_anti"), "no page", F.col("slug"))
    return blank.unionByName(several).unionByName(lost)


def unknown_categories(terms: DataFrame, known: DataFrame) -> DataFrame:
    rows = terms.select("slug", F.explode("categories").alias("category")).join(known.select("category"), "category", "left_anti")
    return finding(rows, "unknown category", F.col("slug"), F.col("category"))


def wrong_subcategory(terms: DataFrame, allowed: DataFrame) -> DataFrame:
    """``allowed (category, subcategory)``: only categories with a list are held to it."""
    rows = terms.filter("subcategory <> ''").withColumn("category", F.try_element_at("categories", F.lit(1)))
    held = rows.join(allowed.select("category").distinct(), "category", "left_semi")
    return finding(held.join(allowed.select("category", "subcategory").distinct(), ["category", "subcategory"], "left_anti"), "wrong subcategory", F.col("slug"), F.col("subcategory"))


def broken_links(terms: DataFrame, key: str = "slug", links: str = "related") -> DataFrame:
    """Links to nothing, or else to the term itself."""
    rows = terms.select(F.col(key).alias("k"), F.explode(links).alias("to"))
    known = terms.select(F.col(key).alias("to")).distinct()
    broken = finding(rows.join(known, "to", "left_anti"), "broken link", F.col("k"), F.col("to"))
    own = finding(rows.join(known, "to", "left_semi").filter("to = k"), "self link", F.col("k"), F.col("to"))
    return broken.unionByName(own)


def drift(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """Keys of one registry that the other lacks, both ways."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return finding(x.join(y, key, "left_anti"), f"not in {b_name}", F.col(key)).unionByName(finding(y.join(x, key, "left_anti"), f"not in {a_name}", F.col(key)))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return finding(n, "duplicate key", F.col(key), F.col("n"))


def english_titles(terms: DataFrame) -> DataFrame:
    """One finding at most: no English title, the slug in its place, or no letter in it."""
    en = F.coalesce("title_en", F.lit(""))
    rule = F.when(en == "", "no english title").when((en == F.col("slug")) & en.contains("-"), "slug as english title").when(~en.rlike("[A-Za-z]"), "english title without letters")
    return terms.withColumn("r", rule).filter("r is not null").select(F.col("r").alias("rule"), F.lit("error").alias("severity"), F.col("slug").alias("key"), en.alias("detail"))


def korean_titles(terms: DataFrame) -> DataFrame:
    """Korean titles without Hangul that are not short product names either."""
    ko = F.col("title_ko")
    return finding(terms.filter((ko != "") & ~ko.rlike("[가-힣]") & ~ko.rlike(r"^[A-Za-z0-9/\-\.\+ ]{1,20}$")), "korean title missing", F.col("slug"), ko)


#: Values that a finding names; it counts the others.
NAMED = 20


def named_some(count: Column, values: Column) -> Column:
    """The first values, and how many more there are."""
    more = count - F.size(values)
    return F.concat(F.array_join(values, ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def sharing_titles(terms: DataFrame) -> DataFrame:
    """``(title, slug)`` of titles that two terms share within overlapping categories: a row for each term."""
    rows = terms.filter("title_ko <> ''").select(F.trim("title_ko").alias("title"), "slug", F.explode(F.array_distinct("categories")).alias("category"))
    # Two terms overlap if they share one category: count terms by title and category.
    twice = rows.groupBy("title", "category").agg(F.countDistinct("slug").alias("n")).filter("n > 1").select("title").distinct()
    return rows.select("title", "slug").distinct().join(twice, "title")


def same_title(terms: DataFrame, every: bool = False) -> DataFrame:
    """A finding for each title of ``sharing_titles``: its first terms and the number of the others, or ``every`` term.

    The first ones come from 64 parts of each title's terms, so that no row or task grows with a title that many share.
    With ``every`` a title's row is as long as its list, which no form of this result can avoid."""
    if every:
        whole = sharing_titles(terms).groupBy("title").agg(F.array_sort(F.collect_list("slug")).alias("slugs"))
        return finding(whole, "same title in category", F.col("title"), F.array_join("slugs", ", "))
    each = sharing_titles(terms).withColumn("part", F.pmod(F.xxhash64("slug"), F.lit(64)))
    for by in (["title", "part"], ["title"]):
        each = each.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("slug"))).filter(F.col("i") <= NAMED)
    counts = sharing_titles(terms).groupBy("title").agg(F.count("*").alias("n"))
    first = each.groupBy("title").agg(F.array_sort(F.collect_list("slug")).alias("slugs")).join(counts, "title")
    return finding(first, "same title in category", F.col("title"), named_some(F.col("n"), F.col("slugs")))


def spelling_drift(terms: DataFrame, title: str) -> DataFrame:
    """Titles that differ only in spacing, dots, dashes, brackets, width or case."""
    forms = terms.filter(F.col(title) != "").select(spelling_key(F.col(title)).alias("k"), F.col(title).alias("form")).distinct()
    several = forms.groupBy("k").agg(F.array_sort(F.collect_set("form")).alias("forms")).filter(F.size("forms") > 1)
    return finding(several, f"spelling drift in {title}", F.col("k"), F.array_join("forms", " / "))


def translation_drift(terms: DataFrame) -> DataFrame:
    """One Korean title, several English ones."""
    rows = terms.filter("title_ko <> ''").select(F.trim("title_ko").alias("title"), spelling_key(F.col("title_en")).alias("en"))
    several = rows.groupBy("title").agg(F.count("*").alias("n"), F.countDistinct("en").alias("n_en")).filter("n > 1 and n_en > 1")
    return finding(several, "several translations", F.col("title"), F.col("n_en"))


def thin_entries(terms: DataFrame) -> DataFrame:
    """No related terms, a definition under twenty characters, no aliases."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    short = (F.col("definition") != "") & (F.length("definition") < 20)
    return (
        finding(terms.filter(none("related")), "no related terms", F.col("slug"), severity="warning")
        .unionByName(finding(terms.filter(short), "short definition", F.col("slug"), F.length("definition"), "warning"))
        .unionByName(finding(terms.filter(none("aliases")), "no aliases", F.col("slug"), severity="warning"))
    )


def edge_rules(terms: DataFrame, most: int = 5) -> DataFrame:
    """Lists of related slugs: empty, too long, repeated, to itself, unknown, unanswered."""
    e = terms.select(F.col("slug").alias("src"), F.explode("related").alias("dst"))
    known = terms.select(F.col("slug").alias("dst"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    valid = e.join(known, "dst", "left_semi").filter("src <> dst").select("src", "dst").distinct()
    repeated = e.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1")
    parts = [
        finding(terms.filter(F.coalesce(F.size("related"), F.lit(-1)) <= 0), "no related terms", F.col("slug")),
        finding(terms.filter(F.size("related") > most), "too many related terms", F.col("slug"), F.size("related"), "warning"),
        finding(repeated, "repeated related term", F.col("src"), F.col("dst")),
        finding(e.filter("src = dst").distinct(), "self link", F.col("src")),
        finding(e.join(known, "dst", "left_anti").distinct(), "unknown related term", F.col("src"), F.col("dst")),
        finding(valid.join(back, ["src", "dst"], "left_anti"), "unanswered link", F.col("src"), F.col("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def has_marks(marks: dict[str, str], html: str = "html") -> list[Column]:
    """A boolean column for each marker, named by its key: whether the page contains it."""
    return [F.coalesce(F.col(html).contains(m), F.lit(False)).alias(name) for name, m in marks.items()]


def page_rules(terms: DataFrame, pages: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Pages (``slug, html``) against terms: missing, orphaned, and without a marker."""
    out = drift(terms, pages, "slug", "terms", "pages")
    both = pages.join(terms.select("slug"), "slug", "left_semi")
    for rule, mark in marks.items():
        out = out.unionByName(finding(both.filter(~F.col("html").contains(mark)), rule, F.col("slug"), severity="warning"))
    return out


def report(findings: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per rule its count, the first ``samples`` keys, and how many more there are."""
    by = findings.groupBy("rule", "severity")
    ranked = findings.withColumn("n", F.row_number().over(_by_rule()))
    heads = ranked.filter(F.col("n") <= samples).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("sample"))
    return by.agg(F.count("*").alias("n")).join(heads, "rule").withColumn("more", F.greatest(F.col("n") - samples, F.lit(0)))


def _by_rule():
    from pyspark.sql import Window

    return Window.partitionBy("rule").orderBy("key", "detail")


def tallies(rows: DataFrame, fate: str = "fate") -> DataFrame:
    """How many rows met each fate."""
    return rows.groupBy(fate).agg(F.count("*").alias("n"))


def merge_batch(existing: DataFrame, batch: DataFrame, pages: DataFrame, required: list[str]) -> DataFrame:
    """Each batch row's fate: ``missing fields``, ``already there``, ``repeated in batch``, ``no page`` or ``accepted``.

    ``batch`` has ``ord``, its order.  A row without a page does not reserve its slug;
    the first that passes all else does.  It is found by partial minima and joined back, so that a slug that a batch repeats
    endlessly is split.
    """
    wrong = F.lit(False)
    for c in required:
        wrong = wrong | F.col(c).isNull() | (F.col(c).cast("string") == "")
    have = existing.select("slug", F.lit(True).alias("old")).distinct()
    paged = pages.select("slug", F.lit(True).alias("paged")).distinct()
    rows = batch.join(have, "slug", "left").join(paged, "slug", "left").withColumn("wrong", wrong)
    free = ~F.col("wrong") & F.col("old").isNull() & F.col("paged").isNotNull()
    taken = rows.filter(free).groupBy("slug").agg(F.min("ord").alias("taken"))
    fate = (
        F.when(F.col("wrong"), "missing fields").when(F.col("old").isNotNull(), "already there")
        .when(F.col("taken") < F.col("ord"), "repeated in batch").when(F.col("paged").isNull(), "no page").otherwise("accepted")
    )
    return rows.join(taken, "slug", "left").withColumn("fate", fate).drop("old", "paged", "wrong", "taken")


# Words that an acronym leaves out.
STOP_WORDS = ("of", "the", "and", "in", "for", "to", "a", "an", "on", "with", "by")


def alias_variants(ko: Column, en: Column) -> Column:
    """Spellings that a term may also be searched by: without or inside brackets, closed up,
    without separators, and the acronym of two to five English words."""
    ko, en = F.coalesce(ko, F.lit("")), F.coalesce(en, F.lit(""))
    inner = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda v: F.trim(v)), lambda v: (F.length(v) > 1) & (F.length(v) <= 30))
    base = F.trim(F.regexp_replace(ko, r"\([^)]*\)", ""))
    seps = r"[·・\-–—/]+"
    forms = F.filter(F.array(ko, base), lambda f: f != "")
    closed = F.transform(F.filter(forms, lambda f: f.contains(" ")), lambda f: F.replace(f, F.lit(" "), F.lit("")))
    parted = F.filter(forms, lambda f: f.rlike(seps))
    words = F.filter(F.split(F.trim(F.regexp_replace(en, r"\([^)]*\)", "")), r"[\s\-]+"), lambda w: w != "")
    content = F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))
    short = (F.size(content) >= 2) & (F.size(content) <= 5) & F.forall(content, lambda w: w.rlike("^[A-Za-z]"))
    acronym = F.when(short, F.array(F.array_join(F.transform(content, lambda w: F.upper(F.left(w, F.lit(1)))), ""))).otherwise(F.array().cast("array<string>"))
    every = F.concat(
        F.when((base != "") & (base != ko), F.array(base)).otherwise(F.array().cast("array<string>")), inner(ko), closed,
        F.transform(parted, lambda f: F.regexp_replace(f, seps, "")), F.transform(parted, lambda f: F.trim(F.regexp_replace(f, seps, " "))), acronym, inner(en),
    )
    return F.array_distinct(F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: v != ""))


def new_aliases(terms: DataFrame) -> DataFrame:
    """``(slug, aliases)``: variants that are nobody's title or current alias of the term and claimed by
    one term only, sorted, once each by lower case."""
    titles = terms.select(F.explode(F.array("title_ko", "title_en")).alias("t")).select(F.lower(F.trim("t")).alias("low")).filter("low <> ''").distinct()
    own = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    offers = terms.select("slug", F.explode(F.array_except(alias_variants(F.col("title_ko"), F.col("title_en")), F.array().cast("array<string>"))).alias("v"), own.alias("own"))
    offers = offers.withColumn("low", F.lower("v")).filter(~F.array_contains("own", F.col("low"))).join(titles, "low", "left_anti")
    single = offers.groupBy("low").agg(F.countDistinct("slug", "v").alias("n")).filter("n = 1").select("low")
    kept = offers.join(single, "low", "left_semi")
    return kept.groupBy("slug").agg(F.array_sort(F.collect_set("v")).alias("aliases"))


def tag_balance(pages: DataFrame, tags: tuple[str, ...] = ("div", "p", "ul", "li", "a", "article", "nav"), key: str = "page_id") -> DataFrame:
    """Pages in which a tag is opened more or less often than it is closed."""
    counts = [F.struct(F.lit(t).alias("tag"), F.size(F.regexp_extract_all("html", F.lit(rf"(?i)<{t}[\s>]"), F.lit(0))).alias("opened"), F.size(F.regexp_extract_all("html", F.lit(rf"(?i)</{t}\s*>"), F.lit(0))).alias("closed")) for t in tags]
    return pages.select(key, F.inline(F.array(*counts))).filter("opened <> closed")


def site_summary(terms: DataFrame, pages: DataFrame, footer: str = "</footer>") -> DataFrame:
    """One row: terms, repeated slugs, pages, pages without a term, terms without a page, pages without a footer."""
    t = terms.select(F.lit("terms").alias("what"), F.col("slug").cast("string").alias("slug"), F.lit(False).alias("bare"))
    p = pages.select(F.lit("pages").alias("what"), F.col("slug").cast("string").alias("slug"), (~F.col("html").contains(footer)).alias("bare"))
    # Both tables by slug in one aggregate: how often it is a term, and a page.
    by = t.unionByName(p).groupBy("slug").agg(F.count_if(F.col("what") == "terms").alias("t"), F.count_if(F.col("what") == "pages").alias("p"), F.count_if("bare").alias("bare"))
    known = F.col("slug").isNotNull()
    return by.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.when(known, F.greatest(F.col("t") - 1, F.lit(0)))), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("pages"), F.coalesce(F.sum("bare"), F.lit(0)).alias("no_footer"),
        F.count_if((F.col("p") > 0) & (F.col("t") == 0)).alias("orphan_pages"), F.count_if((F.col("t") > 0) & (F.col("p") == 0)).alias("missing_pages"),
    )


def order_matches_groups(groups: DataFrame, order: DataFrame) -> DataFrame:
    """``(category, pos, group_pos)`` where the list of categories departs from the groups' codes in
    sequence.  ``groups``: ``(grp_ord, pos, category)``; ``order``: ``(pos, category)``."""
    from pyspark.sql import Window

    flat = groups.withColumn("group_pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("grp_ord", "pos")) - 1).select("category", "group_pos")
    return order.join(flat, "category", "full_outer").filter(~F.col("pos").eqNullSafe(F.col("group_pos"))).select("category", "pos", "group_pos")
