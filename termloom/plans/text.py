"""Matching and text queries over ``documents`` with a dictionary from ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import matching as M
from termloom.plans.common import table


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark, as a dictionary."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))).alias("w"))
    keys = words.distinct()
    return keys.select(
        F.col("w").alias("slug"), F.lit("").alias("title_ko"), F.col("w").alias("title_en"), F.lit(None).cast("string").alias("definition"),
        F.array(F.lit("bench")).alias("categories"), F.lit(None).cast("int").alias("difficulty"), F.lit(0).alias("term_ord"),
    )


_MATCHES = f"""
dict AS (
  SELECT DISTINCT w AS slug, regexp_replace(w, '[-_\\s]', '', 'g') AS key FROM (
    SELECT unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS w FROM benchmark)
), pieces AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?s)(.*?)({T.WORD})', 1)) AS gap,
         unnest(regexp_extract_all(text, '(?s)(.*?)({T.WORD})', 2)) AS word,
         generate_subscripts(regexp_extract_all(text, '(?s)(.*?)({T.WORD})', 2), 1) AS pos
  FROM documents
), words AS (
  SELECT doc_id, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) AS start FROM pieces
), hits AS (
  SELECT doc_id, slug, start, length(word) AS length
  FROM words JOIN dict ON regexp_replace(lower(word), '[-_\\s]', '', 'g') = dict.key WHERE length(dict.key) >= 2
), matches AS (
  SELECT doc_id, slug, count(*) AS n, min(start) AS first_start, arg_min(length, start) AS first_length FROM hits GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_start, slug) AS rank FROM matches
)"""


def match_terms(spark, sf_dir):
    m = M.match_terms(table(spark, sf_dir, "documents"), benchmark_terms(spark, sf_dir))
    return m.select("doc_id", "slug", F.col("count").alias("n"), "first_start", "first_length", "rank")


MATCH_TERMS = f"""WITH {_MATCHES}
SELECT doc_id, slug, n, first_start::INT AS first_start, first_length::INT AS first_length, rank::INT AS rank FROM ranked"""


def match_spans(spark, sf_dir):
    spans = M.kept_spans(M.match_terms(table(spark, sf_dir, "documents"), benchmark_terms(spark, sf_dir)))
    return spans.select("doc_id", "start", "length", "slug", F.array_join("covered", " ").alias("covered"))


MATCH_SPANS = f"""WITH {_MATCHES}, placed AS (
  SELECT h.*, rank, row_number() OVER (PARTITION BY h.doc_id, start ORDER BY length DESC, rank) AS i
  FROM (SELECT DISTINCT * FROM hits) h JOIN ranked r ON r.doc_id = h.doc_id AND r.slug = h.slug
)
SELECT doc_id, start::INT AS start, max(length) FILTER (i = 1)::INT AS length, max(slug) FILTER (i = 1) AS slug,
       string_agg(slug, ' ' ORDER BY i) AS covered FROM placed GROUP BY doc_id, start"""


def token_offsets(spark, sf_dir):
    w = M.word_table(table(spark, sf_dir, "documents"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum("start").alias("sum_start"), F.sum(F.length("word")).alias("sum_length"), F.max("start").alias("last_start"))


TOKEN_OFFSETS = f"""WITH {_MATCHES}
SELECT doc_id, count(*) AS n_words, sum(start)::BIGINT AS sum_start, sum(length(word))::BIGINT AS sum_length, max(start)::INT AS last_start
FROM words GROUP BY doc_id"""


def highlight_html(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spans = M.kept_spans(M.match_terms(docs, benchmark_terms(spark, sf_dir)))
    html = M.highlight(docs, spans)
    return html.select("doc_id", F.length("html").alias("n_html"), F.sha2("html", 256).alias("html_sha256"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
HIGHLIGHT_HTML = f"""WITH {_MATCHES}, placed AS (
  SELECT h.*, rank, row_number() OVER (PARTITION BY h.doc_id, start ORDER BY length DESC, rank) AS i
  FROM (SELECT DISTINCT * FROM hits) h JOIN ranked r ON r.doc_id = h.doc_id AND r.slug = h.slug
), kept AS (
  SELECT doc_id, start, max(length) FILTER (i = 1) AS length, max(slug) FILTER (i = 1) AS slug, string_agg(slug, ' ' ORDER BY i) AS covered
  FROM placed GROUP BY doc_id, start
), gaps AS (
  SELECT k.*, coalesce(lag(start + length) OVER w, 0) AS after_last, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC) = 1 AS is_last
  FROM kept k WINDOW w AS (PARTITION BY doc_id ORDER BY start)
), marked AS (
  SELECT g.doc_id, string_agg({_ESC.format("substring(text, after_last::INT + 1, (start - after_last)::INT)")}
         || '<mark data-slug="' || slug || '" data-covers="' || covered || '">' || {_ESC.format("substring(text, start::INT + 1, length::INT)")} || '</mark>', '' ORDER BY start) AS head,
         max(start + length) AS done
  FROM gaps g JOIN documents d ON d.doc_id = g.doc_id GROUP BY g.doc_id
), html AS (
  SELECT d.doc_id, coalesce(head, '') || {_ESC.format("substring(coalesce(text, ''), coalesce(done, 0)::INT + 1)")} AS html
  FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id
)
SELECT doc_id, length(html)::INT AS n_html, sha256(html) AS html_sha256 FROM html"""


def spam_flags(spark, sf_dir):
    d = table(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", T.detect_spam(F.col("text")).alias("spam"), T.detect_xss(F.col("text")).alias("xss"), T.valid_email(F.col("text")).alias("email"))


_RUNS = "|".join(f"{c}{{10}}" for c in [r"\s", *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"\.", r"\-", r"\*", "=", "_", "#", "!", r"\?", ","])
_XSS = "(?i)" + "|".join(T.XSS_MARKS)
SPAM_FLAGS = rf"""
SELECT conv_id, turn,
       coalesce(regexp_matches(text, '{_RUNS}') OR (len(string_split(text, ' ')) > 5
         AND len(list_distinct(string_split(text, ' '))) < len(string_split(text, ' ')) / 2.0), false) AS spam,
       coalesce(regexp_matches(text, '{_XSS}'), false) AS xss,
       coalesce(regexp_matches(text, '^[^\s@]+@[^\s@]+\.[^\s@]+$'), false) AS email
FROM conversations"""


def input_validation(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.validate_user_input(F.col("text")).alias("v"))
    return d.select("conv_id", "turn", "v.safe", "v.reason", F.sha2(F.col("v.value"), 256).alias("value_sha256"))


_CLEAN = r"left(regexp_replace(trim(coalesce(text, '')), '(?i)\x00|javascript:|vbscript:|data:text/html', '', 'g'), 10000)"
INPUT_VALIDATION = rf"""
WITH c AS (SELECT conv_id, turn, {_CLEAN} AS t FROM conversations), r AS (
  SELECT *, CASE WHEN regexp_matches(t, '{_XSS}') THEN 'xss'
    WHEN regexp_matches(t, '{_RUNS}') OR (len(string_split(t, ' ')) > 5 AND len(list_distinct(string_split(t, ' '))) < len(string_split(t, ' ')) / 2.0) THEN 'spam' END AS reason
  FROM c)
SELECT conv_id, turn, reason IS NULL AS safe, reason,
  CASE WHEN reason IS NULL THEN sha256({_ESC.format("t").replace("&#39;", "&#039;")}) END AS value_sha256 FROM r"""


def doc_hash(spark, sf_dir):
    """Every text is hashed, whatever its length; one that is missing counts as a file that could not be read."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.document_hash(F.col("text"), F.col("source"), F.col("n_chars")).alias("doc_hash"), T.excerpt(F.col("text")).alias("title"))


DOC_HASH = "SELECT doc_id, coalesce(sha256(text), source || ':' || n_chars) AS doc_hash, left(trim(text), 40) || '...' AS title FROM documents"


def doc_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("doc_hash"))
    return d.groupBy("doc_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


DOC_DEDUP = "SELECT sha256(text) AS doc_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1"


def similarity_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.similarity_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


SIMILARITY_TOKENS = """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9가-힣]+', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2) AS t FROM documents)
SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM t"""


def escape_variants(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = [T.escape_html(F.col("text")), T.escape_html(F.col("text"), None), T.escape_xml(F.col("text"))]
    return d.select("doc_id", *[F.sha2(c, 256).alias(n) for c, n in zip(e, ("html", "html_plain", "xml"), strict=True)])


_PLAIN = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
ESCAPE_VARIANTS = f"SELECT doc_id, sha256(replace({_PLAIN}, '''', '&#39;')) AS html, sha256({_PLAIN}) AS html_plain, sha256(replace({_PLAIN}, '''', '&apos;')) AS xml FROM documents"

QUERIES = {
    "match_terms": match_terms, "match_spans": match_spans, "token_offsets": token_offsets, "highlight_html": highlight_html,
    "spam_flags": spam_flags, "input_validation": input_validation, "doc_hash": doc_hash, "doc_dedup": doc_dedup,
    "similarity_tokens": similarity_tokens, "escape_variants": escape_variants,
}
SQL = {
    "match_terms": MATCH_TERMS, "match_spans": MATCH_SPANS, "token_offsets": TOKEN_OFFSETS, "highlight_html": HIGHLIGHT_HTML,
    "spam_flags": SPAM_FLAGS, "input_validation": INPUT_VALIDATION, "doc_hash": DOC_HASH, "doc_dedup": DOC_DEDUP,
    "similarity_tokens": SIMILARITY_TOKENS, "escape_variants": ESCAPE_VARIANTS,
}
