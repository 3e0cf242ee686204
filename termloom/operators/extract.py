"""Reading facts out of HTML pages, and idempotent rewriting of blocks in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import first_filled, slug_of, strip_tags

# Markup that the page template is known by.
RELATED_BLOCK = r'(?s)<div class="related-terms">(.*?)</div>'
DEFINITION = r"한 줄 정의:</strong>\s*([^\n]+)"
EXAMPLE_MARK, SECTION_MARK = 'class="example"', "<h2>왜 중요한가</h2>"


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def page_slugs(links: Column) -> Column:
    """Slugs of the ``.html`` pages among links, each once, in order; queries and fragments go."""
    names = F.transform(links, lambda h: F.regexp_extract(h, r"(?:^|/)([^/]+)\.html(?:[?#].*)?$", 1))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def related_slugs(html: Column) -> Column:
    """Slugs linked in the first related-terms block."""
    return page_slugs(hrefs(F.regexp_extract(html, RELATED_BLOCK, 1)))


def title(html: Column, fallback: Column) -> Column:
    """Text of the first h1, else the fallback."""
    return first_filled(strip_tags(F.regexp_extract(html, "(?s)<h1[^>]*>(.*?)</h1>", 1)), fallback)


def definition(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, DEFINITION, 1))


def redirect_target(html: Column) -> Column:
    """The page that a stub forwards to, or null."""
    target = F.regexp_extract(html, r"""(?i)<meta http-equiv="refresh" content="[^"]*url=([^"]+)""", 1)
    return F.when(target != "", slug_of(F.regexp_replace(target, "[?#].*$", "")))


def link_table(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(id, pos, href)``: every link of every page."""
    return pages.select(id_col, F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def merged_related(existing: Column, extracted: Column, own: Column) -> Column:
    """Existing first, then new ones, without the page itself."""
    none = F.array().cast("array<string>")
    return F.array_except(F.array_union(F.coalesce(existing, none), F.coalesce(extracted, none)), F.array(own))


def upsert_block(html: Column, start: str, end: str, body: str | Column, before: str) -> Column:
    """``struct<html, outcome>``: the block between two markers replaced, or put before an anchor.

    ``outcome``: unchanged, replaced, added, or no-anchor (then the html is as it was).
    Applying it twice changes nothing more.
    """
    body = body if isinstance(body, Column) else F.lit(body)
    block = F.concat(F.lit(start), body, F.lit(end))
    pattern = f"(?s){re.escape(start)}.*?{re.escape(end)}"
    # A literal replacement: cut around the first match instead of escaping $ and \.
    head = F.substring_index(html, start, 1)
    tail = F.substring(html, F.length(head) + F.length(F.regexp_extract(html, pattern, 0)) + 1, F.length(html))
    replaced = F.concat(head, block, tail)
    anchor = F.instr(html, before)
    added = F.concat(F.left(html, anchor - 1), block, F.lit("\n"), F.substring(html, anchor, F.length(html)))
    has = html.rlike(pattern)
    new = F.when(has, replaced).when(anchor > 0, added).otherwise(html)
    outcome = F.when(has & (replaced == html), "unchanged").when(has, "replaced").when(anchor > 0, "added").otherwise("no-anchor")
    return F.struct(new.alias("html"), outcome.alias("outcome"))


def strip_block(html: Column, pattern: str, allowed: list[str]) -> Column:
    """Without the block, unless the page has one of the allowed markers."""
    keep = F.lit(False)
    for mark in allowed:
        keep = keep | html.contains(mark)
    return F.when(keep, html).otherwise(F.regexp_replace(html, f"(?s){pattern}", ""))


def first_template(pages: DataFrame, keywords: DataFrame, text: Column, allowed: list[str]) -> DataFrame:
    """``(page_id, template)``: the first template of which a keyword is in the text.

    ``keywords``: ``(template, tmpl_ord, keyword, kw_ord)``, a short fixed list; it is
    gathered into one array so that no cross join is made.  Only pages with one of the allowed markers count.
    """
    table = keywords.agg(F.sort_array(F.collect_list(F.struct("tmpl_ord", "kw_ord", "keyword", "template"))).alias("k"))
    known = table.first()["k"]
    choices = F.array(*[F.struct(F.lit(r["keyword"]).alias("keyword"), F.lit(r["template"]).alias("template")) for r in known])
    gate = F.lit(False)
    for mark in allowed:
        gate = gate | F.col("html").contains(mark)
    low = F.lower(text)
    hit = F.try_element_at(F.filter(choices, lambda c: low.contains(c["keyword"])), F.lit(1))["template"]
    return pages.filter(gate).select("page_id", hit.alias("template")).filter("template is not null")
