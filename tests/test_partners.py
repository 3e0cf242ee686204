"""Partners, near names, circles, running values and question times against loops, with hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import fuzzy, graph as G, ledger as L, partners, roadmap as R
from termloom.operators.ranking import running
from termloom.sources.shared import kept


def dictionary(spark, seed, n, vocabulary=40, say=9, kinds=(["a"], ["b"], ["a", "b"])):
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randrange(k)))
    order = rng.sample(range(n), n)
    rows = [(f"t{i:03d}", "", words(3), words(say), rng.choice(kinds), [f"t{rng.randrange(n):03d}" for _ in range(rng.randrange(4))], order[i]) for i in range(n)]
    return spark.createDataFrame(rows, "slug string, title_ko string, title_en string, definition string, categories array<string>, related array<string>, term_ord int")


def all_pairs(rows):
    import re

    tok = lambda s: {t for t in re.sub("[^a-z0-9가-힣]+", " ", (s or "").lower()).split() if len(t) >= 2}
    of = {r["slug"]: (set(r["categories"]), tok(f"{r['slug']} {r['title_en']}"), tok(r["definition"])) for r in rows}
    out = {}
    for a, (ca, ta, da) in of.items():
        scored = [(-(100 * len(ca & cb) + 20 * len(ta & tb) + 2 * len(da & db) + 15 * (ca == cb)), b) for b, (cb, tb, db) in of.items() if b != a and ca & cb]
        out[a] = [(b, -s) for s, b in sorted(scored)]
    return out


@pytest.mark.parametrize("seed, sizes", [(1, (4096, 32768)), (2, (7, 11))])
def test_partners_in_pieces_are_all_pairs(spark, seed, sizes):
    """Many common words, so that bounds decide; and pieces so small that every category has several."""
    t = dictionary(spark, seed, 150, say=14)
    p = kept(partners.profiles(t))
    kinds = p.select("sig", "cats", "feats").distinct()
    got = {}
    ranked = partners.ranked_kinds(kinds.withColumn("k", F.lit(6)), kinds, p.select("sig", "slug"), sizes)
    for r in p.select(F.col("slug").alias("src"), "sig").join(ranked, "sig").filter("src <> dst").collect():
        got.setdefault(r["src"], []).append((-r["score"], r["dst"]))
    want = all_pairs(t.collect())
    assert {s: [(b, -x) for x, b in sorted(v)][:5] for s, v in got.items()} == {s: v[:5] for s, v in want.items() if v}


def test_bounds_leave_out_work():
    """With a strong partner the commonest features are looked up for few holders only, and the result is the same."""
    rng = np.random.default_rng(4)
    feats = [np.sort(rng.choice(np.arange(300) * 128 + 2, 20, replace=False, p=(w := 1 / np.arange(1, 301)) / w.sum())) for _ in range(3000)]
    flat, sizes = np.concatenate(feats), np.array([len(f) for f in feats])
    for own, (top, score) in zip(feats[:60], partners.best_of(flat, sizes, feats[:60], [5] * 60), strict=True):
        every = np.array([2 * len(np.intersect1d(own, f)) for f in feats])
        best = np.argsort(-(every.astype(np.int64) << 32 | (len(feats) - np.arange(len(feats)))))[:5]
        assert top.tolist() == best.tolist() and score.tolist() == every[best].tolist()


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["pos"]):
        out.setdefault(r["src"], []).append(r["dst"])
    return out


def refill(best, rel):
    for s in rel:
        for c, _ in best[s] if len(rel[s]) < 3 else ():
            if len(rel[s]) >= 3:
                break
            if c not in rel[s] and len(rel[c]) < 5:
                rel[s].append(c)
                rel[c].append(s)
    return {s: v for s, v in rel.items() if v}


@pytest.mark.parametrize("stretch", [8192, 5])
@pytest.mark.parametrize("equal", [True, False])
def test_refilling_equals_the_loop(spark, stretch, equal):
    """Equal terms, which all want the same partners, and different ones; in one stretch and in many."""
    n = 90 if stretch > 5 else 24
    t = dictionary(spark, 7, n) if not equal else dictionary(spark, 7, n, say=1, kinds=(["a"],)).withColumn("title_en", F.lit(""))
    rows = sorted(t.collect(), key=lambda r: r["term_ord"])
    rel = {r["slug"]: [] for r in rows}
    for r in rows:
        for x in r["related"][:1]:
            if x != r["slug"] and x not in rel[r["slug"]] and len(rel[x]) < 5 and len(rel[r["slug"]]) < 5:
                rel[r["slug"]].append(x)
                rel[x].append(r["slug"])
    start = [(s, d, i) for s, v in rel.items() for i, d in enumerate(v)]
    links = spark.createDataFrame(start, "src string, dst string, pos long")
    assert lists(G.refilled(t, links, stretch)) == refill(all_pairs(rows), {s: list(v) for s, v in rel.items()})


def test_answering_chains_of_any_length(spark):
    """Full lists of four links to the terms before: whether a link is answered hangs on the term before, down a long chain."""
    n = 60
    rows = [(f"t{i:03d}", "", "", "", ["a"], [f"t{j:03d}" for j in range(max(0, i - 4), i)] + [f"t{(i + 7) % n:03d}"], i) for i in range(n)]
    t = spark.createDataFrame(rows, "slug string, title_ko string, title_en string, definition string, categories array<string>, related array<string>, term_ord int")
    rel = {r[0]: [x for x in dict.fromkeys(r[5]) if x != r[0]] for r in rows}
    for s in rel:
        for other in list(rel[s]):
            if s not in rel[other]:
                if len(rel[other]) < 5:
                    rel[other].append(s)
                else:
                    rel[s].remove(other)
    assert lists(G.reciprocated(t, G.clean_edges(t))) == {k: v for k, v in rel.items() if v}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.0, 0.25, 0.4, 0.49])
def test_near_names_are_all_pairs(spark, threshold):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("aab c") for _ in range(rng.randrange(1, 11))).strip() or "a"
    names, queries = {name() for _ in range(150)} | {"zz", "용어집"}, {name() for _ in range(80)} | {"", "q", "용어"}
    want = {(q, x) for q in queries for x in names if q and edits(q, x) / max(len(q), len(x)) <= threshold}
    index = fuzzy.name_index(spark.createDataFrame([(x,) for x in names], "name string"))
    got = fuzzy.near_names(spark.createDataFrame([(q,) for q in queries], "query string"), index, threshold)
    assert {(r["query"], r["name"]) for r in got.collect()} == want
    with pytest.raises(ValueError):
        fuzzy.near_names(index, index, 0.5)


def test_search_puts_exact_hits_first(spark):
    t = spark.createDataFrame([("a", "", "ring", ["band"], 0), ("b", "ring", "rings", None, 1), ("c", "", "string", [], 2), ("d", None, None, None, 3)], "slug string, title_ko string, title_en string, aliases array<string>, term_ord int")
    q = spark.createDataFrame([(" Ring",), ("bund",), (None,), ("",), ("xylophone",)], "query string")
    got = {(r["query"], r["place"]): (r["slug"], r["tier"], round(r["score"], 4)) for r in fuzzy.search_many(q, t).collect()}
    assert got == {("ring", 1): ("a", 0, 0.3), ("ring", 2): ("b", 0, 0.79), ("ring", 3): ("c", 1, 0.2), ("bund", 1): ("a", 1, 0.1125)}


def test_circles(spark):
    rng = random.Random(5)
    n = 40
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(55)}
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            reach[a] |= reach[b]
    want = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
    got = R.strong_components(spark.range(n).select(F.col("id").alias("slug")), spark.createDataFrame(list(edges), "src long, dst long"))
    assert {r["slug"]: r["root"] for r in got.collect()} == want


def test_running_values_in_slices(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), rng.randrange(50), i, rng.choice([None, rng.randrange(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "u int, t int, i int, v int").repartition(3)
    for later in (False, True):
        for own in (False, True):
            got = running(df, ["u"], F.floor(F.col("t") / 7), ["t", "i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.struct("v", "i"))}, later, own)
            got = {r["i"]: (r["s"], r["m"], tuple(r["l"]) if r["l"] else None) for r in got.collect()}
            for u in (1, 2, None):
                mine = sorted((r for r in rows if r[0] == u), key=lambda r: r[1:3])
                for k, r in enumerate(mine):
                    seen = mine[k + (not own) :] if later else mine[: k + own]
                    vs = [x[3] for x in seen if x[3] is not None]
                    least = min(((-1 if x[3] is None else x[3], x[2]) for x in seen), default=None)
                    least = None if least is None else (None if least[0] < 0 else least[0], least[1])
                    assert got[r[2]] == (sum(vs), max(vs, default=None), least)


def questions(spark, n=400, text_ids=False):
    rng = random.Random(8)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([1, 2, 5, 14, 15, 16, 40, 100_000])
        user = rng.choice(["u-1", "u-1", "u-2", "u-3"]) if text_ids else rng.choice([1, 1, 2, 3])
        rows.append((i, user, i % 17, rng.random() < 0.6, at))
    kind = "string" if text_ids else "long"
    return rows, spark.createDataFrame(rows, f"event_id long, user_id {kind}, question long, shown boolean, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def outcomes(rows):
    out = []
    for i, (_, u, q, shown, at) in enumerate(rows):
        if shown:
            nxt = next(((r[3], r[4]) for r in rows[i + 1 :] if r[1] == u), None)
            if nxt and nxt[1] < at + 15:
                out.append((u, q, at, "left" if nxt[0] else "answered", nxt[1]))
            else:
                out.append((u, q, at, "timed_out", at + 15))
    return sorted(out)


def seconds(df):
    return sorted((r["user_id"], r["question"], r["a"], r["outcome"], r["b"]) for r in df.select("user_id", "question", F.unix_seconds("shown_at").alias("a"), "outcome", F.unix_seconds("ended_at").alias("b")).collect())


def test_question_outcomes(spark):
    rows, df = questions(spark, text_ids=True)
    assert seconds(L.question_outcomes(df)) == outcomes(rows)


def test_question_timer_fires_without_an_event(spark, tmp_path):
    from termloom.streaming import state as ST

    rows, df = questions(spark, 120)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.filter("event_id < 60").write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = ST.question_timer(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).start()
    try:
        q.processAllAvailable()
        df.filter("event_id >= 60").write.mode("append").parquet(source)
        q.processAllAvailable()
        # Nothing of any user follows; another's event moves the watermark and the last questions time out.
        spark.createDataFrame([(999, 9, 0, False)], "event_id long, user_id long, question long, shown boolean").withColumn("ts", F.timestamp_seconds(F.lit(rows[-1][4] + 10_000))).write.mode("append").parquet(source)
        q.processAllAvailable()
    finally:
        q.stop()
    assert seconds(spark.read.parquet(out)) == outcomes(rows)


def test_lockouts_of_one_user_in_stretches_and_text_ids(spark):
    """One user's attempts, with pauses, floods and locks, give what one fold over all of them gives; ids stay text."""
    rng = random.Random(6)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([1, 20, 60, 200, 400, 90_000])
        rows.append((i, "7f9c-uuid", rng.random() < 0.75, at))
    df = spark.createDataFrame(rows, "event_id long, user_id string, bad boolean, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
    n, until, want = 0, None, []
    for _, u, bad, s in rows:
        n, until, locked = L.lockout_step(n, until, s * 1_000_000, bad, 5, 300_000_000)
        if locked:
            want.append((u, s, until // 1_000_000, n))
    got = sorted((r["user_id"], r["l"], r["e"], r["n_failures"]) for r in L.lockouts(df, "user_id", F.col("bad")).select("user_id", F.unix_seconds("locked_at").alias("l"), F.unix_seconds("unlocks_at").alias("e"), "n_failures").collect())
    assert got == want and want


def test_bursts_of_one_key(spark):
    rng = random.Random(4)
    at, rows = 0, []
    for i in range(500):
        at += rng.choice([1, 2, 9, 10, 11, 90_000])
        rows.append((i, rng.choice(["a", "a", None]), at, float(i)))
    df = spark.createDataFrame(rows, "event_id long, k string, s long, value double").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
    want = []
    for k in ("a", None):
        last = None
        for _, _, s, v in (r for r in rows if r[1] == k):
            if last is None or s - last >= 10:
                want.append([k, s, v, 0])
            last = s
            want[-1][2:] = [v, want[-1][3] + 1]
    got = L.bursts(df, "k", "10 seconds").select("k", F.unix_seconds("started").alias("s"), "value", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
