"""Every operator on hostile rows and on an empty table."""

import importlib

import pytest
from pyspark.sql import functions as F

from termloom.llm import (
    op_bpe, op_decontam, op_fingerprint, op_langid, op_license, op_linededup, op_simhash, op_suffixdedup, op_tokencount, op_toxicity, queries,
)


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


def bench_of(spark):
    rows = [(0, "gold ring atlas river stone quick amber violet sorrow theory number signal morning window"), (1, None), (2, ""), (3, "too short"), (None, "a b c d e f g h i")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, toks string")


OPERATORS = {
    "suffix": lambda d: op_suffixdedup.suffix_dedup(d),
    "bpe": lambda d: op_bpe.bpe_digest(d, queries.tokenizer_path()),
    "count": lambda d: op_tokencount.token_counts(d, queries.tokenizer_path(queries.RANKS)),
    "toxicity": lambda d: op_toxicity.score(d, op_toxicity.train(d, labels_of(d.sparkSession))),
    "language": lambda d: op_langid.classify(d, op_langid.train(d)),
    "fingerprint": lambda d: op_fingerprint.compare_edited(d),
    "simhash": lambda d: op_simhash.simhash_classes(d),
    "lines": lambda d: op_linededup.line_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(hostile, name):
    """One row for each input row, repeated rows and null ids included."""
    got = OPERATORS[name](hostile)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.select("doc_id").collect())
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in hostile.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(hostile, name):
    assert OPERATORS[name](hostile.filter(F.lit(False))).count() == 0


def test_searches(hostile, spark):
    assert op_license.license_scan(hostile).count() == 0
    # The same rows with a notice and a test item in them: null and repeated ids, clashing columns.
    item = bench_of(spark).first()["text"]
    notice = op_license.TEMPLATES["apache2_line"]
    planted = hostile.withColumn("text", F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.concat_ws("\n", "text", F.lit(notice), F.lit(item))))
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in planted.filter("text is not null").collect())
    scanned = [r for r in op_license.license_scan(planted).collect() if r["license_id"] == "apache2_line"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in scanned) == ids and all(r["containment"] == 1 for r in scanned)
    found = op_decontam.contaminated(planted, bench_of(spark)).collect()
    assert {r["item_id"] for r in found} == {0} and {r["doc_id"] for r in found} == {None if x else i for x, i in ids}
    assert all(r["n_equal"] >= 11 for r in found)
    assert {(r["doc_id"], r["text"]) for r in op_decontam.decontaminate(planted, bench_of(spark)).collect()} == {(4, None), (None, None)}
    assert op_decontam.contaminated(hostile.filter(F.lit(False)), bench_of(spark)).count() == 0
    assert op_decontam.contaminated(hostile, bench_of(spark).filter(F.lit(False))).count() == 0
    assert op_license.license_scan(hostile.filter(F.lit(False))).count() == 0


def test_stages_keep_columns(hostile, spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    bench_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = hostile
    for name, stage in pipeline.STAGES[:-1]:
        out = tmp_path / name.replace(" ", "_")
        stage(spark, docs, str(tmp_path)).write.parquet(str(out))
        after = spark.read.parquet(str(out))
        assert after.columns == docs.columns, name
        docs = after
    last = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() > 0
    empty = hostile.filter(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_against_plain_python(spark):
    """Every document that stays, and its tokens, by loops over the small table."""
    import hashlib
    import itertools
    import re
    from collections import Counter

    from tokenizers import Tokenizer

    pipeline = importlib.import_module("corpus_pipeline")
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = op_langid.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if model.predict(r["text"])[0] != "und"}

    seen = {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if "".join(window).strip(" ") and seen.setdefault(window, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        texts[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)

    prints = {i: op_simhash.fingerprint(t) for i, t in texts.items()}
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)} if w else set() for i, w in words.items()}
    label = {i: i for i in texts}
    links = []
    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if (prints[a] ^ prints[b]).bit_count() <= 2 or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    texts = {i: t for i, t in texts.items() if label[i] == i}

    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    def dirty(t):
        d = tokens(t)
        have = Counter(d)
        for item in items:
            if sum(have[w] > 0 for w in item) < 6:
                continue
            for shift in range(-len(item), len(d)):
                equal = [0 <= shift + j < len(d) and d[shift + j] == w for j, w in enumerate(item)]
                n = min(13, len(item))
                if any(sum(equal[j : j + n]) >= -(-n * 8 // 10) for j in range(max(1, len(item) - n + 1))):
                    return True
        return False

    library = Tokenizer.from_file(queries.tokenizer_path())
    want = set()
    for i, t in texts.items():
        if not dirty(t):
            ids = library.encode(t, add_special_tokens=False).ids
            want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, small).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_run_is_the_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < got.count() <= spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
