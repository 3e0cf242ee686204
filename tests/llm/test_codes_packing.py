"""Vector codes and packing against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from termloom.llm import op_packing, op_vectorcode, queries
from tests.llm.conftest import prose

# 12 vector codes


@pytest.mark.parametrize("k, width, spread", [(1, 3, 5), (7, 2, 2), (64, 4, 3), (64, 4, 200), (40, 1, 9)])
def test_orchard_is_the_nearest_entry(k, width, spread):
    """Ties and equal entries included: the least index wins."""
    rng = np.random.default_rng(k + width)
    entries, q = rng.integers(-spread, spread + 1, (k, width)), rng.integers(-spread, spread + 1, (3000, width))
    at, best = op_vectorcode.Orchard(entries).nearest(q)
    d = ((q[:, None, :] - entries[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_orchard_looks_at_few_entries():
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (64, 2))
    book = op_vectorcode.Orchard(entries)
    for i in range(64):
        assert sorted([i, *book.order[i]]) == list(range(64)) and (np.diff(book.apart[i]) >= 0).all()


def brute_codes(rows):
    """``{(vec_id, code, error, label_error)}`` and the digest, by all distances in Python integers."""
    rows = [(i, label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    length = -(-max([1, *(len(v) for *_, v in rows)]) // 16) * 16
    rows = [(i, label, v + [0] * (length - len(v))) for i, label, v in rows]
    w = length // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:64]
    books = [[part(r[2], p) for r in first] for p in range(16)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(2):
        new = [list(b) for b in books]
        for p in range(16):
            mine = {}
            for _, _, v in rows:
                mine.setdefault(nearest(v, p)[1], []).append(part(v, p))
            for e, vs in mine.items():
                new[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
        books = new
    out = []
    for i, label, v in rows:
        found = [nearest(v, p) for p in range(16)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, d in out:
        total[label] = total.get(label, 0) + d
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i is None, i or 0, code, d, total[label], digest) for i, label, code, d in out))


def test_vector_codes_against_all_distances(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 1, 2, None]), [rng.gauss(0, 0.2) for _ in range(32)]) for i in range(300)]
    rows += [(5, 1, [0.1] * 32), (None, None, [0.0] * 32), (None, 2, [-0.5] * 32), (400, 1, None), (401, 1, [0.1] * 31 + [None]), (402, 1, [float("nan")] * 32), (403, 0, [float("inf")] + [0.0] * 31),
             (404, 0, [0.3] * 7), (405, 0, [])]
    rows += [(1000 + i, 0, rows[3][2]) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, code string, error int")
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in op_vectorcode.compress(df.repartition(3)).collect())
    assert got == brute_codes(rows)


def test_vector_codes_few_rows_and_none(spark):
    schema = "vec_id long, label int, embedding array<float>"
    rows = [(3, None, [1.0, -2.0]), (1, None, [5e30, -5e30])]
    assert op_vectorcode.compress(spark.createDataFrame(rows, schema)).count() == 2
    assert op_vectorcode.compress(spark.createDataFrame([(1, 1, None)], schema)).count() == 0
    assert op_vectorcode.compress(spark.createDataFrame([], schema)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_decoded_vectors_are_near(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(200)], "vec_id long, embedding array<float>").selectExpr("*", "0 AS label")
    rows = op_vectorcode.whole_parts(df, 16, "vec_id", "embedding", "label")
    books = op_vectorcode.train(rows)
    coded = op_vectorcode.codes(rows, books)
    error = {r["vec_id"]: r["error"] for r in coded.collect()}
    exact = {r["vec_id"]: r["x"] for r in rows.collect()}
    for r in op_vectorcode.decode(coded, books).collect():
        assert sum((a - round(256 * b)) ** 2 for a, b in zip(exact[r["vec_id"]], r["approx"], strict=True)) == error[r["vec_id"]]


# 13 packing


@pytest.fixture(scope="module")
def words():
    return op_packing.encoder(queries.tokenizer_path(queries.WORDS))


ODD = ["", "<|endoftext|> a<|endoftext|>b", "a\x1cb  x　y", "é ́x", "İI ǅ", "a" * 5000, "ΣΑΣ ΣΑΣ. ﬁ", "x​y", "don't WON'T it's''s", "Å K ẞ", "漢字。x", "x²½ª", "Été Ñandú, 12.5!"]


def test_ids_are_the_library_s(words):
    rng = random.Random(8)
    texts = [*ODD, *(prose(rng, 300) for _ in range(20))]
    assert [x.tolist() for x in words.encode_all(texts)] == [[*words.library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_long_texts_in_parts(words, monkeypatch):
    monkeypatch.setattr(op_packing, "CHARS", 50)
    monkeypatch.setattr(op_packing, "CACHE", 5)
    rng = random.Random(8)
    for t in [*ODD, "\n" * 200, prose(rng, 500), "x " * 90 + "y" * 120 + " z"]:
        assert words.encode(t).tolist() == [*words.library.encode(t, add_special_tokens=False).ids, 1]


def test_cuts_are_the_cheapest():
    rng = random.Random(6)
    for _ in range(60):
        size = 1 << rng.randrange(4, 10)
        at = np.array(sorted({0, *(rng.randrange(1, 3000) for _ in range(rng.randrange(200, 900)))}))
        if np.diff(at).max() > size:
            continue
        penalty = np.array([rng.choice([0, 1, 24]) for _ in at])
        cost, before = op_packing.best_cuts(at, penalty, size)
        want = [0]
        for j in range(1, len(at)):
            def pad(n):
                return 0 if n & (n - 1) == 0 and n >= op_packing.LEAST_POWER else size - n
            want.append(int(penalty[j]) + min(want[i] + pad(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= size))
        assert cost == want
        assert all(0 < at[j] - at[before[j]] <= size for j in range(1, len(at)))


def check_pieces(rows, texts, enc, size):
    ids = {i: [*enc.library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        pad += op_packing.padding(at, size)
    return pad, sum(map(len, ids.values()))


@pytest.mark.parametrize("stretch", [1 << 19, 3000])
def test_every_id_in_one_piece(spark, corpus, words, stretch, monkeypatch):
    monkeypatch.setattr(op_packing, "STRETCH", stretch)
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()} | dict(enumerate([*ODD, None, prose(random.Random(1), 9000)], 1000))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    for size in (2048, 64):
        pad, n = check_pieces(op_packing.pack(df, queries.tokenizer_path(queries.WORDS), size).collect(), texts, words, size)
        assert pad < 0.02 * n if size == 2048 else pad < 0.2 * n


def test_packing_order_and_sentences(spark, words):
    """Pieces follow the order of the rows, and most cuts inside a document come after a sentence."""
    rng = random.Random(2)
    text = " ".join("the quick ring of gold" + rng.choice(["", " and more stone"]) + "." for _ in range(4000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string").coalesce(1)
    rows = sorted(op_packing.pack(df, queries.tokenizer_path(queries.WORDS)).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert [(r["doc_id"], r["start"]) for r in rows] == sorted((r["doc_id"], r["start"]) for r in rows)
    ids = words.encode(text)
    cuts = [r["start"] for r in rows if r["start"]]
    assert sum(bool(words.ends_sentence[ids[c - 1]]) for c in cuts) > 0.7 * len(cuts) > 0


def test_packing_hostile_rows(spark, hostile):
    path = queries.tokenizer_path(queries.WORDS)
    firsts = op_packing.pack(hostile, path).filter("start = 0").collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in firsts)
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in hostile.select("doc_id").collect())
    assert op_packing.pack(hostile.limit(0), path).count() == 0
