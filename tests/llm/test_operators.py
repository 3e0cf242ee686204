"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import (
    components, op_bpe, op_decontam, op_fingerprint, op_langid, op_license, op_linededup, op_simhash, op_suffixdedup, op_tokencount, op_toxicity, queries, suffixes,
)
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1 suffix-array dedup


def test_suffix_array_is_sorted_order():
    rng = random.Random(1)
    for _ in range(3000):
        x = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(40))]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("many", [200, 1])
def test_suffix_dedup_is_exact(spark, corpus, many):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    ids = sorted(texts)
    want = dict(zip(ids, op_suffixdedup.brute_force([texts[i] for i in ids]), strict=True))
    got = {
        r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in op_suffixdedup.suffix_dedup(corpus, many).collect()
    }
    assert got == want and any(v[1] for v in want.values())


def test_suffix_dedup_inside_one_text_and_low_entropy(spark):
    texts = ["a" * 399, "ab" * 300, "x" * 100 + "".join(chr(97 + i % 26) for i in range(450)) + "y", "".join(chr(97 + i % 26) for i in range(420)), "é" * 250]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"])) for r in op_suffixdedup.suffix_dedup(df).collect()}
    assert got == {i: w[:2] for i, w in enumerate(op_suffixdedup.brute_force(texts))}


def test_suffix_dedup_round_one_core(spark):
    """A passage just under 400 bytes between different bytes in most texts: many different strings with one core, a few of
    which repeat."""
    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(395))
    noise = lambda n: "".join(rng.choice("klmnopqrst ") for _ in range(n))
    texts = [noise(30 + i % 7) + passage + noise(40) for i in range(500)]
    texts += [noise(9) + "mnpq" + passage + "zz" + noise(9), noise(12) + "npq" + passage + "zz" + noise(5), noise(7) + passage + "zzx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(op_suffixdedup.brute_force(texts)))
    for many in (200, 5):
        got = {r["doc_id"]: (r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in op_suffixdedup.suffix_dedup(df, many).collect()}
        assert got == want
    assert 2 < sum(bool(v[1]) for v in want.values())


def test_suffix_dedup_with_one_passage_everywhere(spark):
    """One 500-byte passage in many surroundings: one anchor with as many different runs as documents;
    and a text that is longer than a block."""
    rng = random.Random(31)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(500))
    noise = lambda n: "".join(rng.choice("klmnopqrst ") for _ in range(n))
    texts = [noise(300) + passage + noise(300) for _ in range(400)]
    border = op_suffixdedup.BLOCK
    texts += [noise(border - 250) + passage + noise(border), noise(30) + texts[5][200:900], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in op_suffixdedup.suffix_dedup(df).collect()}
    for i in range(400):
        if i != 5:
            # A character of the surroundings may agree by chance on either side.
            (a, b), = got[i]
            assert a <= 300 and b >= 800 and b - a < 520
    (a, b), = got[400]
    assert a <= border - 250 and b >= border + 250
    assert got[5][0][0] <= 200 and got[5][0][1] >= 900 and got[401][0][0] <= 30 and got[402] == []


def test_query_columns(spark):
    got = queries.op1_suffix_dedup(spark, SMALL)
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    want = [(r["doc_id"], *w) for r, w in zip(texts, op_suffixdedup.brute_force([r["text"] for r in texts]), strict=True)]
    assert sorted(rows_of(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))) == want


# 2 BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    theirs, mine = Tokenizer.from_file(path), op_bpe.vocabulary(path)
    rng = random.Random(3)
    bits = ["a", "the", "<|endoftext|>", "  ", "\n", "é", "漢", "🎉", "1", "'s", "aaaaaa", "<|", " ", "ing", "\x1c", "\x85", "ſ", "²", "’"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ["a" * 20_000, "ab" * 5000]
    for t in texts:
        ids = mine.encode(t)
        assert ids == theirs.encode(t, add_special_tokens=False).ids
        assert mine.decode(np.array(ids, np.int32)) == theirs.decode(ids, skip_special_tokens=False) == t


@pytest.mark.parametrize("out_chars", [op_bpe.OUT_CHARS, 1000])
def test_bpe_round_trip_is_encode_then_decode(spark, hostile, out_chars):
    path = queries.tokenizer_path()
    want = op_bpe.bpe_decode(op_bpe.bpe_encode(hostile, path), path)
    assert sorted(map(str, rows_of(op_bpe.bpe_round_trip(hostile, path, out_chars)))) == sorted(map(str, rows_of(want)))


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert sorted(rows_of(queries.op2_bpe(spark, SMALL))) == sorted(want)


# 3 token counts


def test_token_counts_are_the_best_segmentation():
    scores = op_tokencount.unigram_scores(queries.tokenizer_path(queries.RANKS))
    counter = op_tokencount.TokenCounter(scores)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abeinorst") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"étude", " the", "漢字"})

    def best(raw: bytes) -> int:
        found = []
        for cuts in itertools.product((0, 1), repeat=len(raw) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(raw[last:i])
                    last = i
            parts.append(raw[last:])
            if all(p in scores for p in parts):
                found.append((-sum(scores[p] for p in parts), len(parts)))
        low = min(f[0] for f in found)
        return min(n for s, n in found if s < low + 1e-9)

    want = {w: best(w.encode()) for w in words}
    assert {w: counter.tokens(w) for w in words} == want
    # Every prefix is one node, whatever the order of insertion, and terminal nodes keep the counts.
    assert len(counter.best) == len({w.encode()[:i] for w in words for i in range(len(w.encode()) + 1)})
    assert {w: counter.many[n] for w, n in counter.ends.items()} == want
    small = op_tokencount.TokenCounter(scores, nodes=40)
    assert small.count([" ".join(words), None, ""] * 3) == op_tokencount.TokenCounter(scores).count([" ".join(words), None, ""] * 3)


def test_token_count_query(spark):
    """Against a plain dynamic programme over each pre-token."""
    import regex

    from termloom.llm.pretokens import PATTERN

    scores = op_tokencount.unigram_scores(queries.tokenizer_path(queries.RANKS))
    longest = max(map(len, scores))

    def tokens(raw):
        best = [(0.0, 0)]
        for end in range(1, len(raw) + 1):
            options = [(-(s + -best[at][0]), best[at][1] + 1) for at in range(max(0, end - longest), end) if (s := scores.get(raw[at:end])) is not None]
            best.append(min(options))
        return best[-1][1]

    known = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        pieces = regex.findall(PATTERN, r["text"] or "")
        known[r["doc_id"]] = (len(pieces), sum(tokens(p.encode()) for p in pieces) if len(pieces) < 1500 else None)
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in queries.op3_token_counts(spark, SMALL).collect()}
    assert got.keys() == known.keys()
    assert all(got[k][0] == v[0] and v[1] in (None, got[k][1]) for k, v in known.items())


# 4 toxicity and 5 language ID


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_toxicity_on_held_out_rows(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert ((got["predicted"] == 1) == (got["score"] >= 0.3)).all() and got["score"].between(0, 1).all()
    test = both[both["held_out"]]
    assert auc(test["score"].to_numpy(), (test["toxic"] == 1).to_numpy()) > 0.9


def plain_grams(text, sizes, bits):
    """Buckets of a text's byte n-grams, from the definition."""
    kept = [c if 97 <= c <= 122 or c >= 128 else 32 for c in (" " + (text or "").lower() + " ").encode()]
    kept = [c for i, c in enumerate(kept) if c != 32 or i == 0 or kept[i - 1] != 32]
    out = []
    for n in sizes:
        for i in range(len(kept) - n + 1):
            h = n
            for c in kept[i : i + n]:
                h = (h * 0x100000001B3 + c + 1) % 2**64
            out.append(h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - bits)
    return out


def test_scores_from_the_models_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = op_toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    language = op_langid.train(docs)
    for r in docs.limit(12).collect():
        features = {int(model.slot[b]) for b in plain_grams(r["text"], op_toxicity.SIZES, op_toxicity.BITS)} - {-1}
        z = model.bias + sum(float(model.weight[f]) for f in features)
        assert abs(model.score(r["text"]) - 1 / (1 + np.exp(-z))) < 1e-9
        grams = plain_grams(r["text"], op_langid.SIZES, op_langid.BITS)
        margin = sum(language.weights[g] for g in grams) / len(grams) / language.scale
        loss = [sum(w * np.log1p(np.exp(-2 * c * m)) for w, c, m in zip(language.weight_of_bit, code, margin, strict=True)) for code in language.codes]
        assert language.predict(r["text"])[0] == language.languages[int(np.argmin(loss))]


def test_every_gram_counts_once_across_stretches():
    from termloom.llm import ngrams

    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2_400_000))
    whole = np.bincount(np.concatenate(ngrams.hashed(ngrams.letters(text), op_langid.SIZES, op_langid.BITS)), minlength=1 << op_langid.BITS)
    assert (op_langid.counts_of(text) == whole).all()


def test_languages_that_lose_alike():
    """The first in order of name; a text of one language is not ambiguous where no other was learned."""
    model = op_langid.LanguageModel(["aa", "bb"], op_langid.codewords(2), np.zeros((1 << op_langid.BITS, 1)), np.ones(1), np.ones(1))
    assert model.predict("x") == ("aa", 0.5, True)


def test_toxicity_sample_bounds_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert op_toxicity._examples(docs, labels, 10).count() <= 2


def test_toxicity_with_one_kind_of_label(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int")
    model = op_toxicity.train(docs, labels)
    assert all(r["score"] < 0.01 for r in op_toxicity.score(docs, model).collect())


def test_language_on_held_out_rows(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    test = got.merge(docs, on="doc_id").query("held_out")
    assert (test["lang_pred"] == test["lang"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_language_without_letters(spark):
    docs = spark.createDataFrame([(1, "bonjour le monde", "fr"), (3, "hello the world", "en"), (4, "123 !!", "en"), (5, None, "fr"), (7, "½ ² Ⅷ ١", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in op_langid.classify(docs, op_langid.train(docs)).collect()}
    assert got[4] == got[5] == got[7] == "und"
    assert {r["doc_id"] for r in op_langid.identified(docs, op_langid.train(docs)).collect()} == {1, 3}


@pytest.mark.parametrize("k", [1, 2, 3, 5, 12])
def test_codewords_differ(k):
    codes = op_langid.codewords(k)
    assert len({tuple(r) for r in codes}) == k and set(np.unique(codes)) <= {-1.0, 1.0}


# 6 decontamination


def test_masks_hit_every_two_substitutions():
    for wrong in itertools.combinations(range(op_decontam.OVERLAP), 2):
        assert any(
            all(at + i not in wrong for i in mask) for mask in op_decontam.MASKS for at in range(op_decontam.OVERLAP - op_decontam.SPAN + 1)
        )


@pytest.mark.parametrize("limit", [op_decontam.BROADCAST_TOKENS, 0])
def test_contamination_with_substitutions(spark, limit):
    rng = random.Random(8)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    short = [f"s{i}" for i in range(9)]

    def text(words, before=20):
        return " ".join([f"d{rng.randrange(10**6)}" for _ in range(before)] + words + [f"d{rng.randrange(10**6)}" for _ in range(20)])

    one_in_seven = [("zz" if i % 7 == 3 else w) for i, w in enumerate(item)]
    every_third = [("zz" if i % 3 == 0 else w) for i, w in enumerate(item)]
    long_before = 5 * op_decontam.PART + 3
    docs = spark.createDataFrame(
        [(1, text(item)), (2, text(one_in_seven)), (3, text(every_third)), (4, text(item[5:18])), (5, text(item[5:12])), (6, text([])), (7, text(short)),
         (8, text(item, long_before)), (9, " ".join(item[:20]).upper()), (10, text(item[20:], 0))],
        "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in op_decontam.contaminated(docs, bench, limit).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 0), (7, 1), (8, 0), (9, 0), (10, 0)}
    assert got[1, 0]["shift"] == 20 and got[8, 0]["shift"] == long_before and got[10, 0]["shift"] == -20
    assert (got[1, 0]["item_from"], got[1, 0]["item_to"]) == (0, 40)
    clean = {r["doc_id"] for r in op_decontam.decontaminate(docs, bench).collect()}
    assert clean == {3, 5, 6}


@pytest.mark.parametrize("limit", [op_decontam.BROADCAST_TOKENS, 0])
def test_every_allowed_substitution_is_found(spark, limit):
    """Lengths 8 to 13, each against a comparison of all alignments without masks."""
    items, docs, want = [], [], set()
    for n in range(8, 14):
        item = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        allowed = n - -(-n * 8 // 10)
        for k in range(allowed + 2):
            for wrong in itertools.combinations(range(n), k):
                i = len(docs)
                text = ["a", "b"] + [("zz" if j in wrong else w) for j, w in enumerate(item)] + ["c"]
                docs.append((i, " ".join(text)))
                equal = max(sum(0 <= j + s < len(text) and text[j + s] == w for j, w in enumerate(item)) for s in range(-n, len(text)))
                if equal >= -(-n * 8 // 10):
                    want.add((i, n))
    got = op_decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_decontamination_tells_rows_of_one_id_apart(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (None, "clean"), (None, None), (7, "so clean"), (7, "x " + item), (8, "fine")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = {(r["doc_id"], r["text"]) for r in op_decontam.decontaminate(docs, bench).collect()}
    assert left == {(None, "clean"), (None, None), (7, "so clean"), (8, "fine")}


# 7 fingerprints


def test_fingerprint_contract(spark):
    docs = spark.createDataFrame([(3, "abc def ghi jkl" * 9), (1, None), (2, "zyx" * 50), (5, "🎉é" * 7)], "doc_id long, text string")
    texts = [(1, ""), (2, "zyx" * 50), (3, "abc def ghi jkl" * 9), (5, "🎉é" * 7)]
    got = {r["doc_id"]: r for r in op_fingerprint.compare_edited(docs).collect()}
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == op_fingerprint.digest(t.encode()) and r["edited_fingerprint"] == op_fingerprint.digest(edited.encode())
        assert r["near_next"] == op_fingerprint.likeness(op_fingerprint.digest(t.encode()), op_fingerprint.digest(after.encode()))


def plain_digest(data: bytes):
    """Length code, checksum and quartile of each bucket, from the definition."""
    import math

    table = random.Random(0).sample(range(256), 256)
    b = data if len(data) >= 5 else data.ljust(5, b"\0")
    counts, check = [0] * 256, 0
    for end in range(4, len(b)):
        for salt, offs in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))):
            h = table[salt + 1]
            for o in offs:
                h = table[h ^ b[end - o]]
            counts[h] += 1
            check += h if salt == 0 else 0
    low = sorted(counts[:128])
    quartile = [sum(c > low[q] for q in (31, 63, 95)) for c in counts[:128]]
    return (0 if not data else min(255, 1 + int(math.log(len(data)) / math.log(1.1)))), check % 256, quartile


def test_digest_and_likeness_from_the_definition():
    rng = random.Random(13)
    texts = [b"", b"abc", b"a" * 700, *(prose(rng, n).encode() for n in (5, 40, 300))]
    texts += [texts[-1].replace(b"gold", b"lead"), "été 漢字 🎉".encode() * 20]
    plain = [plain_digest(t) for t in texts]
    for t, (length, check, quartile) in zip(texts, plain, strict=True):
        body = [sum(q << s for q, s in zip(quartile[i : i + 4], (6, 4, 2, 0), strict=True)) for i in range(0, 128, 4)]
        assert bytes.fromhex(op_fingerprint.digest(t)) == bytes([length, check, *body])
    for (a, ca, qa), (b, cb, qb) in itertools.product(plain, repeat=2):
        far = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(qa, qb, strict=True)) + 12 * min(63, max(0, abs(a - b) - 1)) + 12 * (ca != cb)
        x, y = (op_fingerprint.digest(texts[plain.index(p)]) for p in ((a, ca, qa), (b, cb, qb)))
        assert abs(op_fingerprint.likeness(x, y) - (1 - far / (128 * 6 + 12 * 63 + 12))) < 1e-12


def test_digest_across_stretches():
    rng = random.Random(2)
    data = b"".join(rng.choice([b"gold ", b"ring ", b"atlas "]) for _ in range(220_000))
    assert len(data) > op_fingerprint.STRETCH
    whole = op_fingerprint.digest(data)
    from unittest import mock

    with mock.patch.object(op_fingerprint, "STRETCH", 1000):
        assert op_fingerprint.digest(data) == whole


def test_edits_are_nearer_than_strangers(spark):
    got = queries.op7_fingerprint(spark, "/root/testdata/sf0.01").toPandas()
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.9
    assert op_fingerprint.likeness("00" * 34, "00" * 34) == 1.0 and op_fingerprint.likeness("00" * 34, "ff" * 34) >= 0


# 8 licenses


def test_license_scan_against_all_windows(spark):
    rng = random.Random(6)
    names = list(op_license.TEMPLATES)
    texts = [prose(rng, rng.randrange(200)) + " " + (op_license.TEMPLATES[rng.choice(names)] if i % 2 else "") + " " + prose(rng, rng.randrange(100)) for i in range(80)]
    texts += ["", "MIT", op_license.TEMPLATES["mit_line"], prose(rng, 20_000) + " " + op_license.TEMPLATES["gpl_notice"]]
    scanner = op_license.Scanner(op_license.TEMPLATES)
    for t in texts:
        s, want = op_license.shingles(t), {}
        for block, inside, *_ in scanner.classes:
            for n in inside:
                for w in range(-(-len(s) // block)):
                    share = len(np.unique(s[w * block : (w + 2) * block][np.isin(s[w * block : (w + 2) * block], scanner.sets[n])])) / len(scanner.sets[n])
                    if share >= op_license.CONTAINED:
                        want[n] = max(share, want.get(n, 0))
        assert {m[0]: m[1] for m in scanner.scan(t)} == want
    got = op_license.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} >= set(range(1, 80, 2))


def plain_scan(text, templates):
    """Containment of every template in the best window, by sets of word runs."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out, w = {}, words(text)
    for name, t in templates.items():
        own = words(t)
        width = min(5, len(own))
        runs = lambda x: [tuple(x[i : i + width]) for i in range(len(x) - width + 1)]  # noqa: E731, B023
        want, have = set(runs(own)), runs(w)
        block = 1 << (len(runs(own)) - 1).bit_length()
        best = max((len(want.intersection(have[i : i + 2 * block])) / len(want) for i in range(0, len(have), block)), default=0)
        if best >= (0.8 if len(own) >= 5 else 1):
            out[name] = best
    return out


def test_license_scan_from_the_definition(spark):
    every = op_license.TEMPLATES | op_license.FULL_TEMPLATES | op_license.SHORT_TEMPLATES
    rng = random.Random(16)
    texts = {-1: prose(rng, 9000) + " " + op_license.FULL_TEMPLATES["bsd3_text"] + " " + prose(rng, 50)}
    for i, t in enumerate(op_license.FULL_TEMPLATES.values()):
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts[-2 - i] = prose(rng, 30) + "\n" + " ".join(words)
    texts |= {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {}
    for r in op_license.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], {})[r["license_id"]] = r["containment"]
    want = {i: m for i, t in texts.items() if (m := plain_scan(t, every))}
    assert {i: {n: round(v, 9) for n, v in m.items()} for i, m in found.items()} == {i: {n: round(v, 9) for n, v in m.items()} for i, m in want.items()}
    query = {(r["doc_id"], r["license_id"]) for r in queries.op8_license_scan(spark, SMALL).collect()}
    assert query == {(i, n) for i, m in want.items() if i >= 0 for n in m}


def test_license_templates_from_a_table(spark):
    table = spark.createDataFrame([("mine", "one two three four five six seven")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "nothing")], "doc_id long, text string")
    assert [(r["doc_id"], r["license_id"], r["containment"]) for r in op_license.license_scan(docs, table).collect()] == [(1, "mine", 1.0)]


def test_license_limits():
    with pytest.raises(ValueError):
        op_license.Scanner({"x": "too short"})


def test_short_notices(spark):
    rng = random.Random(7)
    long = prose(rng, 300)
    texts = ["All rights reserved.", "Copyright 2020 ACME.\nALL RIGHTS  RESERVED!\n" + long, long + " all rights are reserved", "all rights", "of all rights reserved", long + " SPDX-License-Identifier: MIT",
             "all rights reserved all rights reserved " + op_license.TEMPLATES["mit_line"], None]
    got = op_license.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(rows_of(got)) == [
        (0, "all_rights_reserved", 1.0, 0, 1), (1, "all_rights_reserved", 1.0, 3, 2), (4, "all_rights_reserved", 1.0, 1, 2), (5, "spdx_mit", 1.0, 300, 2),
        (6, "all_rights_reserved", 1.0, 0, 3), (6, "mit_line", 1.0, 6, 2), (6, "mit_name", 1.0, 8, 2),
    ]
    planted = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("text").rlike(r"(?m)^All rights reserved\.$")).collect()}
    found = queries.op8_license_scan(spark, "/root/testdata/sf0.01").filter("license_id = 'all_rights_reserved'")
    assert planted and {r["doc_id"] for r in found.collect()} >= planted


# 9 SimHash


def classes_of(fps, distance=2):
    ids = list(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(ids, 2):
            if bin(fps[a] ^ fps[b]).count("1") <= distance and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_fingerprint_by_the_letter(spark):
    text = "The QUICK brown\tfox É x jumps\x0bover THE lazy dog"
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\x0b", " ").split(" ") if w]
    hashes = [r["h"] & (2**64 - 1) for r in spark.createDataFrame([(" ".join(words[i : i + 3]),) for i in range(len(words) - 2)], "s string").selectExpr("xxhash64(s) h").collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert op_simhash.fingerprint(text) == want
    assert op_simhash.fingerprint(None) == op_simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("limit", [24, 1])
def test_close_pairs_are_all_pairs(spark, limit, distance):
    rng = random.Random(17)
    values = {6, 7, 3, 4} | {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) for c in (rng.getrandbits(64) for _ in range(12)) for _ in range(8)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    want = {(max(a, b), min(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
    got = rows_of(op_simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, pair_limit=limit))
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [24, 1])
def test_close_pairs_lose_no_link(spark, limit):
    rng = random.Random(12)
    centre = [rng.getrandbits(64) for _ in range(20)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for c in centre for _ in range(12)}
    fps = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in fps.values()], "fp long")
    links = op_simhash.close_pairs(df, pair_limit=limit)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = classes_of(fps)
    groups = {}
    for i, v in fps.items():
        s = v - 2**64 if v >> 63 else v
        groups.setdefault(roots.get(s, s), set()).add(i)
    expected = {}
    for i, r in want.items():
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_components(spark, corpus):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in op_simhash.simhash_classes(corpus).collect()}
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: op_simhash.fingerprint(t) for i, t in texts.items()}
    assert {i: c for i, (_, c) in got.items()} == classes_of({i: f for i, (f, _) in got.items()})
    kept = {r["doc_id"] for r in op_simhash.near_dedup(corpus).collect()}
    assert kept == {c for _, c in got.values()}


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, 80) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b), (3, c), (None, c), (None, "other words here")], "doc_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in op_simhash.near_dedup(docs).collect()), key=str)
    assert left == sorted([(1, a), (1, b), (None, c), (None, "other words here")], key=str)


def closure(pairs):
    """Members of each class of linked numbers, by plain union."""
    at = {}
    for u, v in pairs:
        both = at.get(u, {u}) | at.get(v, {v})
        at.update(dict.fromkeys(both, both))
    return {frozenset(c) for c in at.values()}


@pytest.mark.parametrize("limit, part_rows", [(24, 1024), (1, 1024), (1, 3)])
def test_near_copies_go(spark, limit, part_rows):
    """Pairs of Jaccard similarity 0.8 or more, and no others, against all pairs; in large
    buckets the links make the same classes."""
    rng = random.Random(21)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200]))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3):
            for at in rng.sample(range(len(words)), edits):
                words[at] = "changed"
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    rows = spark.createDataFrame(list(enumerate(texts)), "own long, text string")
    got = {tuple(sorted(p)) for p in rows_of(op_simhash.alike_pairs(rows, pair_limit=limit, part_rows=part_rows))}
    assert want and got <= want and closure(got) == closure(want) and (limit == 1 or got == want)
    if limit > 1:
        import corpus_pipeline

        left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, rows.withColumnRenamed("own", "doc_id"), "").collect()}
        assert all(not {i, j} <= left for i, j in want) and len(left) >= 20


@pytest.mark.parametrize("part_rows", [1024, 16])
def test_large_bucket_loses_no_class(spark, part_rows):
    """Copies of one text that are 0.6 to 0.8 like it and near each other in small families only:
    comparing with one of them finds few links, the parts find the rest."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(base)]
    for f in range(40):
        family = list(base)
        for at in rng.sample(range(300), 9):
            family[at] = f"f{f}x{at}"
        for m in range(3):
            words = list(family)
            for at in rng.sample(range(300), 2):
                words[at] = f"m{f}y{m}z{at}"
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    rows = spark.createDataFrame(list(enumerate(texts)), "own long, text string")
    got = {tuple(sorted(p)) for p in rows_of(op_simhash.alike_pairs(rows, part_rows=part_rows))}
    classes = closure(want)
    assert len(classes) > 20 and got <= want and closure(got) == classes


# 10 line dedup


def test_line_dedup_keeps_first_places(spark):
    a = "l1\nl2\nl3\nl4"
    docs = spark.createDataFrame(
        [(1, a), (2, "x\n" + a + "\ny"), (3, "l1\nl2\nz"), (4, "p\np\np\np"), (5, "\n\n\n\n"), (6, None), (7, "l2\nl3\nl4"), (8, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["__llm_n_lines"], r["__llm_n_removed"]) for r in op_linededup.line_dedup(docs).collect()}
    assert got == {
        1: (a, 4, 0), 2: ("x\ny", 6, 4), 3: ("l1\nl2\nz", 3, 0), 4: ("p", 4, 3), 5: ("\n\n\n\n", 5, 0), 6: (None, 0, 0), 7: ("", 3, 3), 8: ("", 1, 0),
    }
