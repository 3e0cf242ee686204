"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
and read again as the next one's ``docs``.  All but the last return the columns
of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import op_bpe, op_decontam, op_langid, op_linededup, op_simhash
from termloom.llm.common import discard, durable, table
from termloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language (``und``: no letter at all) go."""
    return op_langid.identified(docs, op_langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in repeated three-line windows go from all but their first place;
    ``n_chars`` follows the text.  A document may become empty but stays."""
    kept = op_linededup.line_dedup(docs).select(*[f"`{c}`" for c in docs.columns])
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of least doc_id; SimHash links and texts
    whose five-word shingles have a Jaccard similarity of 0.8 or more make a class."""
    return op_simhash.near_dedup(docs, jaccard=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return op_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, as query ``op2_bpe``."""
    return op_bpe.bpe_digest(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]

#: Learned classifiers, near-duplicate closure and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            before, docs = written, durable(docs)
            written = docs
            if before is not None:
                discard(before)
    return docs
