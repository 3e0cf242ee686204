"""Positional dictionary matching, ranking, span resolution and highlighting."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from termloom.functions.text import LETTERS, candidate_forms, escape_html, normalize_word, word_occurrences
from termloom.operators.dictionary import sent_to_all, title_keys
from termloom.operators.ranking import running, slices
from termloom.sources.shared import kept, texts_a_batch


def word_table(docs: DataFrame, letters: str = LETTERS, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, word, start)``: every word of every text."""
    texts_a_batch(docs.sparkSession)
    at = docs.select(F.col(id_col).alias("doc_id"), word_occurrences(F.col("text"), letters).alias("at"))
    # The outer form: the plain one makes Catalyst compute the array twice, to drop empty ones first.
    return at.select("doc_id", F.inline_outer("at")).filter("word is not null")


def known_words(docs: DataFrame, terms: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``(word, slug, term_ord, cut, form_ord)``: the different words of the texts that are keys of terms,
    as a whole (``form_ord`` 0) or without a particle of ``cut`` letters.

    Normal forms and particles are worked out once for each different word, of which there
    are far fewer than occurrences; a batch of texts gives each of its words once.
    """
    texts_a_batch(docs.sparkSession)
    every = re.compile(f"[{letters}]+").findall

    def different(batches):
        for b in batches:
            found: set[str] = set()
            for t in b.column(0).to_pylist():
                found.update(every(t or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["word"])

    words = docs.select("text").mapInArrow(different, "word string").distinct()
    forms = words.withColumn("form", normalize_word(F.col("word"))).select("word", F.posexplode_outer(candidate_forms(F.col("form"))).alias("form_ord", "f"))
    keys = kept(title_keys(terms))
    return forms.join(sent_to_all(keys), F.col("f.form") == F.col("key")).select("word", "slug", "term_ord", F.col("f.cut").alias("cut"), "form_ord")


def hits(docs: DataFrame, terms: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``(doc_id, slug, term_ord, start, length, form_ord, word)``: a row for each word
    occurrence and form that is a key of a term.

    A word whose raw and stripped forms both lead to one term counts twice.
    """
    known = kept(known_words(docs, terms, letters))
    return word_table(docs, letters).join(sent_to_all(known), "word").select(
        "doc_id", "slug", "term_ord", "start", (F.length("word") - F.col("cut")).alias("length"), "form_ord", "word"
    )


def match_terms(docs: DataFrame, terms: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per document and term found: counts, occurrences and the rank in the document.

    ``count`` counts (occurrence, form) pairs, ``n_starts`` places.  Ranks go by
    count, then by where the term's word first appears, form and term order.
    """
    # What follows groups by document and by parts of it: all of it in the one stage after this shuffle.  Spark sorts the hits, a task streams them.
    found = hits(docs, terms, letters).select("doc_id", "slug", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"), "form_ord", "term_ord")
    found = found.repartition("doc_id").sortWithinPartitions("doc_id", "slug", "start", "length")
    kinds = {c: found.schema[c].dataType for c in ("doc_id", "slug", "form_ord", "term_ord")}
    form = (
        "doc_id {doc_id}, slug {slug}, count long, n_starts long, occurrences array<struct<start:int,length:int>>, first_seen struct<start:int,form_ord:{form_ord},term_ord:{term_ord}>"
    ).format(**{c: k.simpleString() for c, k in kinds.items()})
    types = [to_arrow_type(x.dataType) for x in StructType.fromDDL(form)]
    per_term = found.mapInArrow(lambda batches: _per_term(batches, types), form).withColumn("score", F.lit(0.0))
    order = W.partitionBy("doc_id").orderBy("score", F.desc("count"), "first_seen", "slug")
    return per_term.select(
        "doc_id", "slug", "count", "n_starts", "score", "occurrences",
        F.col("occurrences")[0]["start"].alias("first_start"),
        F.col("occurrences")[0]["length"].alias("first_length"),
        F.row_number().over(order).alias("rank"),
    )


#: Rows that a task works on together.
TOGETHER = 32_768


def _stretches(batches):
    """Batches in lists of ``TOGETHER`` rows or more."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += len(b)
        if n >= TOGETHER:
            yield some
            some, n = [], 0
    yield some


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, null among them."""
    return np.asarray(column.dictionary_encode("encode").indices)


def _per_term(batches, types: list):
    """Sorted hits as one row for each document and term; only the last one's hits, which may go on, are held."""
    names, held = ["doc_id", "slug", "count", "n_starts", "occurrences", "first_seen"], []

    def rows(b: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        start, length, form, term = (b.column(i) for i in range(2, 6))
        n = np.diff(np.append(begins, len(b)))
        at, run = np.asarray(start), np.repeat(np.arange(len(begins)), n)
        new = np.append(True, (np.diff(at) != 0) | (np.diff(run) != 0))
        # The first place, then the form and term that come first there.
        near = np.flatnonzero(at == at[begins][run])
        order = np.lexsort((np.asarray(term.fill_null(-(1 << 31)))[near], np.asarray(form)[near], run[near]))
        best = near[order][np.searchsorted(run[near][order], np.arange(len(begins)))]
        seen = pa.StructArray.from_arrays([start.take(best), form.take(best), term.take(best)], fields=list(types[5]))
        places = pa.StructArray.from_arrays([start, length], fields=list(types[4].value_type))
        ends = pa.array(np.append(begins, len(b)), pa.int32())
        columns = [b.column(0).take(begins), b.column(1).take(begins), pa.array(n, pa.int64()), pa.array(np.add.reduceat(new.astype(np.int64), begins)), pa.ListArray.from_arrays(ends, places, type=types[4]), seen]
        return pa.RecordBatch.from_arrays(columns, names)

    for some in _stretches(batches):
        some = [x for x in [*held, *some] if len(x)]
        if not some:
            continue
        b = pa.concat_batches(some)
        doc, slug = _codes(b.column(0)), _codes(b.column(1))
        begins = np.append(0, np.flatnonzero((np.diff(doc) != 0) | (np.diff(slug) != 0)) + 1)
        if len(begins) > 1:
            yield rows(b.slice(0, begins[-1]), begins[:-1])
        held = [b.slice(begins[-1])]
    if held:
        yield rows(pa.concat_batches(held), np.array([0]))


def kept_spans(matches: DataFrame) -> DataFrame:
    """``(doc_id, start, length, slug, covered)``: one span for each matched place.

    Spans of exact matches begin at a word and end inside it, so they overlap only
    where they share the start: the longest stays, then the best ranked; the
    others' slugs are folded into ``covered``.
    """
    spans = matches.select("doc_id", "slug", "rank", F.inline("occurrences"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("shorter"), "rank", "slug"))).alias("s")
    return spans.groupBy("doc_id", "start").agg(best).select(
        "doc_id", "start", (-F.col("s")[0]["shorter"]).alias("length"), F.col("s")[0]["slug"].alias("slug"),
        F.array_distinct(F.transform("s", lambda x: x["slug"])).alias("covered"),
    )


def sweep_spans(spans: DataFrame) -> DataFrame:
    """The general sweep over any spans ``(doc_id, start, length, slug)`` of a document: kept ones with what they ``covered``.

    Earliest first, longer before shorter, then by ``ord``; a span that begins before the last
    kept one ends is folded into it.  Spark sorts each document's spans and a task streams them, holding one
    kept span at a time, so the work is linear in the spans however many a document has.
    """
    placed = spans.withColumn("ord", F.monotonically_increasing_id()) if "ord" not in spans.columns else spans
    rows = placed.select("doc_id", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"), "slug", "ord")
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "start", F.desc("length"), "ord").drop("ord")
    ids, slugs = (rows.schema[c].dataType for c in ("doc_id", "slug"))

    def sweep(batches):
        types = [to_arrow_type(t) for t in (ids, IntegerType(), IntegerType(), slugs, ArrayType(slugs))]
        held = []
        for some in _stretches(batches):
            some = [x for x in [*held, *some] if len(x)]
            if not some:
                continue
            b = pa.concat_batches(some)
            doc, slug = _codes(b.column(0)), _codes(b.column(3))
            start, length = np.asarray(b.column(1)), np.asarray(b.column(2))
            tops, last, end = [], None, 0
            for i, (d, s, n) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                if d != last or s >= end:
                    tops.append(i)
                    last, end = d, s + n
            # Each slug of a kept span once, at its first place.
            of = np.zeros(len(b), np.int64)
            of[tops[1:]] = 1
            of = np.cumsum(of)
            firsts = np.sort(np.unique(of * (int(slug.max()) + 1) + slug, return_index=True)[1])
            yield _spans(b, np.array(tops[:-1], np.int64), firsts[of[firsts] < len(tops) - 1], of, types)
            # The last kept span may go on; of what it covers, a row for each slug is enough.
            held = [b.take(pa.array(firsts[of[firsts] == len(tops) - 1]))]
        if held:
            b = pa.concat_batches(held)
            yield _spans(b, np.array([0]), np.arange(len(b)), np.zeros(len(b), np.int64), types)

    kinds = ids.simpleString(), slugs.simpleString()
    return rows.mapInArrow(sweep, f"doc_id {kinds[0]}, start int, length int, slug {kinds[1]}, covered array<{kinds[1]}>")


def _spans(b: pa.RecordBatch, tops: np.ndarray, firsts: np.ndarray, of: np.ndarray, types: list) -> pa.RecordBatch:
    """The rows ``tops`` of a batch, each with the slugs of those ``firsts`` that are ``of`` it."""
    ends = np.searchsorted(of[firsts], np.arange(len(tops) + 1))
    covered = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column(3).take(pa.array(firsts)), type=types[4])
    return pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(tops)) for i in range(4)], covered], ["doc_id", "start", "length", "slug", "covered"])


_ENTITIES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})


@F.pandas_udf(StringType())
def _marked(text: pd.Series, starts: pd.Series, lengths: pd.Series, opening: pd.Series) -> pd.Series:
    """Escaped texts with their spans marked: one pass over each, where Spark's substring would begin
    at the front again for every span."""

    def one(t, ss, ns, os):
        out, at = [], 0
        for s, n, o in zip(ss, ns, os, strict=True):
            out += [t[at:s].translate(_ENTITIES), o, t[s : s + n].translate(_ENTITIES), "</mark>"]
            at = s + n
        return "".join([*out, t[at:].translate(_ENTITIES)])

    return pd.Series([one(*x) for x in zip(text, starts, lengths, opening, strict=True)], dtype=object)


def highlight(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, html)``: escaped text with each kept span in a ``mark``.

    A document without spans is its escaped text.
    """
    own = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "slug", "covered"))).alias("own"))
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(own, "doc_id", "left")
    own = F.coalesce("own", F.array().cast(own.schema["own"].dataType))
    opening = F.transform(own, lambda s: F.concat(F.lit('<mark data-slug="'), s["slug"], F.lit('" data-covers="'), F.array_join(s["covered"], " "), F.lit('">')))
    starts, lengths = F.transform(own, lambda s: s["start"].cast("int")), F.transform(own, lambda s: s["length"].cast("int"))
    return both.select("doc_id", _marked("text", starts, lengths, opening).alias("html"))


# Labels of the three levels of difficulty.
DIFFICULTY_LABELS = {1: "쉬움", 2: "보통", 3: "어려움"}


def term_cards(matches: DataFrame) -> DataFrame:
    """``(slug, html)``: a list item per match; definition and difficulty if present."""
    en = F.when(F.col("title_en") != "", F.concat(F.lit(' <span class="term-en">('), escape_html(F.col("title_en")), F.lit(")</span>")))
    definition = F.when(F.col("definition") != "", F.concat(F.lit('<p class="term-card-definition">'), escape_html(F.col("definition")), F.lit("</p>")))
    label = F.create_map(*[F.lit(x) for kv in DIFFICULTY_LABELS.items() for x in kv])[F.col("difficulty")]
    level = F.when(label.isNotNull(), F.concat(F.lit('<span class="term-card-difficulty" data-difficulty="'), F.col("difficulty").cast("string"), F.lit('">'), label, F.lit("</span>")))
    none = F.lit("")
    html = F.concat(
        F.lit('<li class="term-card" data-slug="'), F.col("slug"), F.lit('"><span class="term-card-name">'), escape_html(F.col("title_ko")),
        F.coalesce(en, none), F.coalesce(level, none), F.lit("</span>"), F.coalesce(definition, none),
        F.lit('<a href="terms/'), F.col("slug"), F.lit('.html" class="term-card-detail">→</a></li>'),
    )
    return matches.select("slug", html.alias("html"))


def facet_filter(matches: DataFrame, hidden: DataFrame | None = None, title: str = "", difficulties: list[int] | None = None, category: str | None = None, english_only: bool = False) -> DataFrame:
    """Matches by facets; an unknown difficulty passes every choice of levels."""
    out = matches if hidden is None else matches.join(hidden.select("slug").distinct(), "slug", "left_anti")
    if title:
        out = out.filter(F.lower("title_ko").contains(title.lower()) | F.lower("title_en").contains(title.lower()))
    if difficulties is not None:
        out = out.filter(F.col("difficulty").isNull() | F.col("difficulty").isin(*difficulties))
    if category:
        out = out.filter(F.array_contains("categories", category))
    if english_only:
        out = out.filter(~F.coalesce(F.col("title_ko"), F.lit("")).rlike("[가-힣]"))
    return out


#: Characters of a bin in which leaves and ranges meet.
BIN = 1024


def clip_to_leaves(leaves: DataFrame, ranges: DataFrame, width: int = BIN) -> DataFrame:
    """Ranges of a page's text as pieces of its text leaves.

    ``leaves``: ``(page_id, leaf, text)``, joined by one space; ``ranges``:
    ``(page_id, range_id, start, end)``.  Gives ``(page_id, range_id, leaf, from, to)`` inside
    each leaf.

    Leaves and ranges go to the bins of ``width`` characters that they touch and meet there, each pair in the bin where the
    later one of the two begins.  So a page of any size is spread over its bins, and
    a leaf never meets ranges that lie elsewhere; where leaves stand is a sum over slices of the page (``running``).
    """
    sized = running(leaves, ["page_id"], slices(leaves, "leaf", width), ["leaf"], {"_end": ("sum", F.length(F.coalesce("text", F.lit(""))) + 1)})
    end = F.col("_end") - 1
    placed = sized.select("page_id", "leaf", (end - F.length(F.coalesce("text", F.lit("")))).alias("leaf_start"), end.alias("leaf_end"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(a, b) / width))).alias("bin")
    left = placed.select("*", bins("leaf_start", "leaf_end"))
    right = ranges.select("page_id", "range_id", "start", "end", bins("start", "end"))
    return (
        left.join(right, ["page_id", "bin"])
        .filter((F.col("bin") == F.floor(F.greatest("start", "leaf_start") / width)) & (F.col("leaf_start") < F.col("end")) & (F.col("leaf_end") > F.col("start")))
        .select(
            "page_id", "range_id", "leaf",
            (F.greatest("start", "leaf_start") - F.col("leaf_start")).alias("from"),
            (F.least("end", "leaf_end") - F.col("leaf_start")).alias("to"),
        )
    )
