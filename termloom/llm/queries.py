"""Queries of the corpus operators over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.llm.common import P, table


def op8_license_scan(spark, sf_dir):
    from termloom.llm.op_license import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    from termloom.llm.op_simhash import simhash_classes

    return simhash_classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op10_line_dedup(spark, sf_dir):
    from termloom.llm.op_linededup import line_dedup

    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col(f"{P}n_lines").alias("n_lines"),
        F.col(f"{P}n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP10_SQL = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, i AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls) - 2)) AS i FROM l WHERE len(ls) >= 3)
  WHERE trim(ls[i] || ls[i + 1] || ls[i + 2]) <> ''
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM w)
  WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)
), line AS (
  SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM l
), kept AS (
  SELECT line.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t
  FROM line ANTI JOIN gone ON line.doc_id = gone.doc_id AND line.pos = gone.pos GROUP BY 1
)
SELECT d.doc_id, coalesce(len(l.ls), 0)::BIGINT AS n_lines,
       (coalesce(len(l.ls), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d JOIN l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op1_suffix_dedup(spark, sf_dir):
    from termloom.llm.op_suffixdedup import suffix_dedup

    found = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.col("shared").alias("shares_passage"),
    )


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark, sf_dir):
    from termloom.llm.op_bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


RANKS = "byte_bpe_50k.tiktoken"


def op3_token_counts(spark, sf_dir):
    from termloom.llm.op_tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(RANKS))


def op4_toxicity(spark, sf_dir):
    from termloom.llm.common import held_out
    from termloom.llm.op_toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_language_id(spark, sf_dir):
    from termloom.llm.common import held_out
    from termloom.llm.op_langid import classify, train

    docs = table(spark, sf_dir, "documents")
    found = classify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_fingerprint(spark, sf_dir):
    from termloom.llm.op_fingerprint import compare_edited

    return compare_edited(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    from termloom.llm.op_decontam import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shift", "n_equal")


#: Every alignment of every document with every item that has an equal token, without masks.
OP6_SQL = r"""
WITH dt AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents
), bt AS MATERIALIZED (
  SELECT item_id, row_number() OVER () AS i, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) >= 8
), bw AS MATERIALIZED (SELECT i, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS q FROM bt
), dw AS (SELECT r, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS p FROM dt
), eq AS (SELECT r, i, p - q AS shift, q FROM dw JOIN bw USING (w)
), many AS (SELECT r, i, shift, list(q ORDER BY q) AS qs FROM eq GROUP BY ALL HAVING count(*) >= 7
), run AS (
  SELECT r, i, shift, q, count(*) OVER (PARTITION BY r, i, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n
  FROM (SELECT r, i, shift, unnest(qs) AS q FROM many)
), good AS (
  SELECT r, i, shift, max(n) AS n_equal FROM run JOIN dt USING (r) JOIN bt USING (i)
  WHERE least(len(bt.t), len(dt.t) - shift) - greatest(0, -shift) >= 8
  GROUP BY r, i, shift, len(bt.t) HAVING max(n) >= ceil(least(len(bt.t), 13) * 0.8)
)
SELECT doc_id, item_id, arg_max(shift, (n_equal, -shift))::BIGINT AS shift, max(n_equal)::BIGINT AS n_equal
FROM good JOIN dt USING (r) JOIN bt USING (i) GROUP BY doc_id, item_id
"""


PIECES = "piece_bpe_32k.model"


def op11_alignment(spark, sf_dir):
    from termloom.llm.op_alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op12_vector_code(spark, sf_dir):
    from termloom.llm.op_vectorcode import compress

    return compress(table(spark, sf_dir, "embeddings"))


#: Parts and entries by position, distances of all parts to all entries, twice a new codebook, once more the codes.
OP12_SQL = """
WITH kept AS (
  SELECT vec_id, label, embedding AS v, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT vec_id, (j - 1) // w AS p, (j - 1) % w AS i, floor(256 * v[j]::DOUBLE)::BIGINT AS c
  FROM (SELECT vec_id, v, w, unnest(generate_series(1, len(v))) AS j FROM kept)
), b0 AS (
  SELECT p, e, i, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
), d0 AS (
  SELECT vec_id, p, e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b0 b USING (p, i) GROUP BY ALL
), a0 AS (SELECT vec_id, p, min({'d': d, 'e': e}).e AS e FROM d0 GROUP BY ALL
), b1 AS (
  SELECT p, e, i, coalesce(n.c, b0.c) AS c
  FROM b0 LEFT JOIN (SELECT p, e, i, floor(sum(c) / count(*))::BIGINT AS c FROM x JOIN a0 USING (vec_id, p) GROUP BY ALL) n USING (p, e, i)
), d1 AS (
  SELECT vec_id, p, e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b1 b USING (p, i) GROUP BY ALL
), a1 AS (SELECT vec_id, p, min({'d': d, 'e': e}).e AS e FROM d1 GROUP BY ALL
), b2 AS (
  SELECT p, e, i, coalesce(n.c, b1.c) AS c
  FROM b1 LEFT JOIN (SELECT p, e, i, floor(sum(c) / count(*))::BIGINT AS c FROM x JOIN a1 USING (vec_id, p) GROUP BY ALL) n USING (p, e, i)
), d2 AS (
  SELECT vec_id, p, e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b2 b USING (p, i) GROUP BY ALL
), a2 AS (SELECT vec_id, p, min({'d': d, 'e': e}) AS m FROM d2 GROUP BY ALL
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 JOIN kept USING (vec_id) GROUP BY ALL
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM b2) AS codebooks_sha256
FROM coded
"""


WORDS = "word_bpe_49k.json"


def op13_packing(spark, sf_dir):
    from termloom.llm.op_packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(WORDS))


def queries():
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_bpe": op2_bpe,
        "op3_token_counts": op3_token_counts,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_decontamination": op6_decontamination,
        "op7_fingerprint": op7_fingerprint,
        "op8_license_scan": op8_license_scan,
        "op9_simhash": op9_simhash,
        "op10_line_dedup": op10_line_dedup,
        "op11_alignment": op11_alignment,
        "op12_vector_code": op12_vector_code,
        "op13_packing": op13_packing,
    }


def oracle_sql():
    """Queries that SQL can express; the others are tested against brute force."""
    return {
        "op6_decontamination": OP6_SQL,
        "op10_line_dedup": OP10_SQL,
        "op12_vector_code": OP12_SQL,
    }
