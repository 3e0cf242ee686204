import random

import pytest

WORDS = "the of and gold ring atlas river stone quick amber violet sorrow theory number signal morning window garden".split()


def prose(rng: random.Random, n: int) -> str:
    """``n`` words in lines of about ten."""
    words = [rng.choice(WORDS) + rng.choice(["", "", "ed", "s", "ing"]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 10]) for i in range(0, n, 10))


#: Columns whose names operators use inside or return, as extra columns of the input.
CLASH = {"fp": "x", "score": 0.5, "n_tokens": 1, "h1": 2, "spans": "s", "count": 3, "lang_pred": "zz", "toks": "t", "doc": "d", "starts": 4, "w": 5}


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 200)
    rows = [
        (1, base, "en"), (1, base, "en"), (2, base, "en"), (3, base + " tail", "en"), (4, None, "en"), (5, "", None), (6, long, "en"), (7, "x", "en"),
        (None, base, "en"), (None, None, None), (8, "\n\n\n\n", "en"), (9, "été ß 漢字 🎉 \x00 <|endoftext|>", "fr"), (10, "a" * 5000, "en"), (11, prose(rng, 60), None),
    ]
    rows = [(*r, "src", None if r[1] is None else len(r[1]), *CLASH.values()) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, n_tokens int, h1 int, spans string, count int, lang_pred string, toks string, doc string, starts int, w int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def corpus(spark):
    """A few hundred short documents with copies, near copies and shared passages."""
    rng = random.Random(9)
    shared = [prose(rng, 90) for _ in range(3)]
    texts = []
    for i in range(160):
        t = prose(rng, rng.randrange(0, 160))
        if i % 5 == 0:
            t = t + "\n" + shared[i % 3] + "\n" + prose(rng, 20)
        if i % 7 == 0 and texts:
            t = texts[-1]
        if i % 11 == 0 and texts:
            words = texts[-2 if len(texts) > 1 else -1].split(" ")
            words[len(words) // 2] = "changed"
            t = " ".join(words)
        texts.append(t)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
