"""op1's ``shares_passage``: over 50 words in a row that another document has, too, whatever their bytes."""

import random

import pytest

from termloom.llm import op_suffixdedup, passages, rolling


def brute_force(texts):
    """By all windows of 51 words and the documents that hold each."""
    words = ["".join(" " if c in "\t\n\v\f\r " else c for c in t or "").split(" ") for t in texts]
    words = [[w for w in ws if w] for ws in words]
    where = {}
    for i, ws in enumerate(words):
        for k in range(len(ws) - 50):
            where.setdefault(tuple(ws[k : k + 51]), set()).add(i)
    return [any(len(where[tuple(ws[k : k + 51])]) > 1 for k in range(len(ws) - 50)) for ws in words]


def shared(df):
    return [(r["doc_id"], r["shared"]) for r in op_suffixdedup.suffix_dedup(df).collect()]


def test_short_passages_are_told(spark):
    """51 short words are under 400 bytes: nothing goes, but the document is named."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    p = [words(n) for n in (51, 50, 51, 51)]
    assert len(p[0]) < 400
    texts = [
        f"{words(30)} {p[0]} {words(40)}", f"{words(7)}\n{p[0]}\t{words(3)}", f"{words(9)} {p[1]} {words(9)}", f"{words(80)} {p[1]} {words(2)}",
        f"{words(9)} {p[2]} {words(9)} {p[2]} {words(9)}", p[3], p[3].replace(" ", " \r\n"), words(50), None, "", words(400),
    ]
    texts += [texts[7], texts[10], " ".join(p[0].split(" "))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_force(texts)
    assert sorted(shared(df)) == list(enumerate(want))
    assert [i for i, w in enumerate(want) if w] == [0, 1, 5, 6, 10, 12]
    gone = {r["doc_id"] for r in op_suffixdedup.suffix_dedup(df).collect() if r["spans"]}
    assert not gone & {0, 1, 5, 6}


@pytest.mark.parametrize("seed", range(2))
def test_shared_is_exact(spark, seed):
    """Cut, joined and repetitive texts, in which passages of 45 to 60 words recur."""
    rng = random.Random(seed)
    source = [rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(3000)]
    texts = []
    for i in range(400):
        t = [rng.choice("klmnop") + rng.choice("qrstu") for _ in range(rng.randrange(100))]
        at = rng.randrange(2940)
        t += source[at : at + rng.randrange(20, 60)] + (["le"] * rng.randrange(45, 58) if i % 40 == 0 else [])
        texts.append(" ".join(t + [rng.choice("klmnop") for _ in range(rng.randrange(20))]))
    texts += texts[:5]
    want = brute_force(texts)
    assert 20 < sum(want) < 380
    assert sorted(shared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))) == list(enumerate(want))


def test_rows_that_agree_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, t), (None, "x " + t), (3, "y z"), (3, "y z"), (None, "w1 w2")], "doc_id long, text string")
    assert sorted(shared(df), key=str) == sorted([(None, True), (None, True), (3, False), (3, False), (None, False)], key=str)


def test_words_do_not_hang_on_blocks():
    """A text of several blocks, one word longer than a block: each word has the hash it has alone."""
    rng = random.Random(8)
    text = b" ".join([b"%d" % rng.randrange(10**6) for _ in range(60_000)] + [b"a" * (2 * rolling.BLOCK), b"end", "é".encode()])
    alone = {w: int(passages.word_hashes(w)[0]) for w in set(text.split())}
    assert passages.word_hashes(text).tolist() == [alone[w] for w in text.split()] and len(set(alone.values())) == len(alone)
    words = passages.word_hashes(b" ".join(b"%d" % i for i in range(rolling.BLOCK + 300)))
    covered = sorted(k for start, count, _, _ in passages.word_runs(words) for a, n in zip(start.tolist(), count.tolist(), strict=True) for k in range(a, a + n))
    assert covered == list(range(len(words) - 50))
