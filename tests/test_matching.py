"""Matching, spans and highlighting on small dictionaries."""

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import matching as M

BASE = [
    ("p-value", "유의확률", "p-value"),
    ("correlation", "상관관계", "Correlation"),
    ("anova", "분산분석", "ANOVA"),
]


def terms(spark, rows):
    return spark.createDataFrame(
        [(s, ko, en, f"about {s}", ["stat"], None, i) for i, (s, ko, en) in enumerate(rows)],
        "slug string, title_ko string, title_en string, definition string, categories array<string>, difficulty int, term_ord int",
    )


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, text, rows=BASE):
    return {r["slug"]: r for r in M.match_terms(docs(spark, text), terms(spark, rows)).collect()}


def test_word_offsets_rebuild_the_text(spark):
    texts = ["먼저 상관관계, a-b c\nd", "", "  x", "a😀b 가나", None, "12 34"]
    df = docs(spark, *texts).select("text", T.word_occurrences(F.col("text")).alias("at"))
    for r in df.collect():
        for w in r["at"]:
            assert r["text"][w["start"] :].startswith(w["word"])
    assert [len(r["at"]) for r in df.collect()] == [5, 0, 1, 3, 0, 0]


def test_counts_both_languages(spark):
    got = found(spark, "이 연구는 유의확률(p-value)이 0.05 미만일 때 상관관계가 유의하다. 상관관계 분석을 반복했다.")
    assert {k: v["count"] for k, v in got.items()} == {"p-value": 2, "correlation": 2}


def test_most_frequent_first(spark):
    got = found(spark, "상관관계, 상관관계, 상관관계는 유의확률과 다르다.")
    assert got["correlation"]["rank"] == 1 and got["p-value"]["rank"] == 2


def test_words_match_whole(spark):
    assert found(spark, "ANOVAtest is not the same as ANOVA test.")["anova"]["count"] == 1
    assert not found(spark, "응답자 중 불성실 응답을 제외", [("buddha-nature", "불성", "Buddha-nature")])


def test_first_place(spark):
    text = "먼저 상관관계, 그리고 Correlation."
    m = found(spark, text)["correlation"]
    assert text[m["first_start"] : m["first_start"] + m["first_length"]] == "상관관계"


def test_particles_and_everyday_words_are_no_keys(spark):
    rows = [("rho-option", "로", "Rho"), ("danga", "단가", "Danga (Song)"), ("correlation", "상관관계", "Correlation")]
    assert set(found(spark, "95%로 나타났다. 단가는 그래프로 상관관계가 뚜렷하다.", rows)) == {"correlation"}


@pytest.mark.parametrize("text,marks", [("조건 a < b 상관관계", 1), ("상관관계, 상관관계, 상관관계.", 3), ("분산분석을 하고 집단 간 분산분석 값", 2)])
def test_highlight(spark, text, marks):
    d = docs(spark, text)
    html = M.highlight(d, M.kept_spans(M.match_terms(d, terms(spark, BASE)))).first()["html"]
    assert html.count("<mark") == marks and " < " not in html
    import re

    plain = re.sub("<[^>]+>", "", html).replace("&lt;", "<").replace("&amp;", "&")
    assert plain == text


def test_overlap_is_folded(spark):
    rows = [("sample-i", "표본이", ""), ("sample", "표본", "Sample")]
    d = docs(spark, "이 연구의 표본이 크다")
    spans = M.kept_spans(M.match_terms(d, terms(spark, rows))).collect()
    assert len(spans) == 1 and set(spans[0]["covered"]) == {"sample-i", "sample"} and spans[0]["slug"] == "sample-i"


def test_general_sweep_against_a_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(d, rng.randrange(30), rng.randrange(1, 9), f"s{i}", i) for d in range(40) for i in range(rng.randrange(8))]
    got = {}
    for r in M.sweep_spans(spark.createDataFrame(rows, "doc_id long, start int, length int, slug string, ord int")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["slug"], list(r["covered"])))
    for d in {r[0] for r in rows}:
        kept = []
        for _, start, length, slug, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], -r[2], r[4])):
            if not kept or start >= kept[-1][0] + kept[-1][1]:
                kept.append((start, length, slug, [slug]))
            else:
                kept[-1][3].append(slug)
        assert sorted(got[d]) == sorted(kept)


def test_cards(spark):
    rows = [("x", "a < b & \"c\"", None, None, 2), ("y", "이름", "Name", "정의", None)]
    html = {r["slug"]: r["html"] for r in M.term_cards(spark.createDataFrame(rows, "slug string, title_ko string, title_en string, definition string, difficulty int")).collect()}
    assert "a &lt; b &amp; &quot;c&quot;" in html["x"] and "term-card-definition" not in html["x"] and "보통" in html["x"]
    assert "(Name)" in html["y"] and "정의" in html["y"] and "difficulty" not in html["y"]


def test_clip_to_leaves(spark):
    leaves = spark.createDataFrame([(1, 0, "abc"), (1, 1, "de"), (1, 2, "fgh")], "page_id int, leaf int, text string")
    ranges = spark.createDataFrame([(1, 7, 1, 8)], "page_id int, range_id int, start int, end int")
    got = [(r["leaf"], r["from"], r["to"]) for r in M.clip_to_leaves(leaves, ranges).orderBy("leaf").collect()]
    assert got == [(0, 1, 3), (1, 0, 2), (2, 0, 1)]


def test_sweep_of_a_long_document(spark):
    """Spans that overlap in any way, one document with most of them, against the loop."""
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["d", "d", "d", "e", None]), rng.randrange(4000), rng.randrange(1, 9), f"s{rng.randrange(30)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id string, start int, length int, slug string, ord int")
    got = {}
    for r in M.sweep_spans(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["slug"], r["covered"]))
    for d in ("d", "e", None):
        want = []
        for _, start, length, slug, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], -r[2], r[4])):
            if want and start < want[-1][0] + want[-1][1]:
                if slug not in want[-1][3]:
                    want[-1][3].append(slug)
            else:
                want.append((start, length, slug, [slug]))
        assert sorted(got[d]) == want


def test_leaves_and_ranges_in_bins(spark):
    """One page of many leaves, long, short and empty ones, and many ranges, against all pairs."""
    import random

    rng = random.Random(2)
    leaves = [(1, i, "x" * rng.choice([0, 1, 5, 30, 300])) for i in range(200)] + [(2, 0, None), (2, 1, "abc")]
    ranges = [(rng.choice([1, 1, 1, 2]), i, s := rng.randrange(6000), s + rng.choice([0, 1, 10, 900])) for i in range(300)]
    got = M.clip_to_leaves(spark.createDataFrame(leaves, "page_id int, leaf int, text string"), spark.createDataFrame(ranges, "page_id int, range_id int, start int, end int"), 16)
    want, at = set(), {}
    for page, leaf, text in leaves:
        start = at.get(page, 0)
        end = start + len(text or "")
        at[page] = end + 1
        want |= {(page, i, leaf, max(s, start) - start, min(e, end) - start) for p, i, s, e in ranges if p == page and start < e and end > s}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_hits_are_streamed_in_order(spark, monkeypatch):
    """Hits of documents and terms that go on over several batches, against a loop; no lists are collected by Spark."""
    import random

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    monkeypatch.setattr(M, "TOGETHER", 3)
    rng = random.Random(6)
    rows = sorted({(rng.choice([1, 2, 5]), rng.choice("abc"), rng.randrange(6), rng.randrange(1, 4), rng.randrange(3), rng.randrange(4)) for _ in range(90)}, key=lambda r: r[:4])
    names = ["doc_id", "slug", "start", "length", "form_ord", "term_ord"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 2], strict=True), kinds, strict=True)], names) for i in range(0, len(rows), 2)]
    form = "doc_id long, slug string, count long, n_starts long, occurrences array<struct<start:int,length:int>>, first_seen struct<start:int,form_ord:int,term_ord:bigint>"
    got = [tuple(r.values()) for b in M._per_term(iter(batches), [to_arrow_type(x.dataType) for x in StructType.fromDDL(form)]) for r in b.to_pylist()]
    want = []
    for key in sorted({r[:2] for r in rows}):
        own = [r[2:] for r in rows if r[:2] == key]
        seen = min((s, f, t) for s, _, f, t in own)
        want.append((*key, len(own), len({r[0] for r in own}), [{"start": s, "length": n} for s, n, *_ in own], dict(zip(("start", "form_ord", "term_ord"), seen, strict=True))))
    assert got == want
    plan = M.match_terms(docs(spark, "상관관계"), terms(spark, BASE))._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
