"""What the findings of a round named, on small tables."""

import hashlib
import random

from pyspark.sql import functions as F

from termloom.plans import registry


def test_shift_is_rounded_as_in_sql(spark, tmp_path):
    """Thirteen documents: a fifth is 2.6, which the SQL rounds to three."""
    spark.range(13).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3,), (11,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r["slug"] for r in registry.queries()["unknown_translations"](spark, str(tmp_path)).collect()] == [14]


def test_short_texts_are_hashed_too(spark, tmp_path):
    rows = [(1, "short", "s", 5), (2, None, "s", 7), (3, "x" * 300, "s", 300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["doc_hash"] for r in registry.queries()["doc_hash"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() if t else f"{s}:{n}" for i, t, s, n in rows}


def parts(spark, path, n):
    """``n`` parts of one name, type and brand, and one that stands alone."""
    p = spark.range(n + 1).select(
        F.col("id").alias("p_partkey"), F.when(F.col("id") < n, "old ring").otherwise("new plate").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"),
        F.lit(3).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    p.write.parquet(f"{path}/part.parquet")
    return ", ".join(sorted(f"part-{i}" for i in range(n)))


def test_same_title_names_every_part(spark, tmp_path):
    every = parts(spark, tmp_path, 30)
    assert [(r["key"], r["detail"]) for r in registry.queries()["dq_same_title"](spark, str(tmp_path)).collect()] == [("old ring", every)]


def test_category_overlap_digests_every_part(spark, tmp_path):
    every = parts(spark, tmp_path, 30)
    got = registry.queries()["dq_category_overlap"](spark, str(tmp_path)).collect()
    assert [(r["key"], r["slugs_sha256"]) for r in got] == [("old ring", hashlib.sha256(every.encode()).hexdigest())]


def test_links_in_groups_and_tasks_by_size(spark, tmp_path, monkeypatch):
    """Links inside brands are those of all links whose ends share one; tasks follow the number of lines."""
    from termloom.plans import common

    lines = [(o, p) for o in range(40) for p in {o % 7, o * 3 % 11, o * o % 5, 20}] + [(0, 20)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    groups = spark.createDataFrame([(p, None if p == 3 else p % 2) for p in range(21)], "l_partkey long, grp int")
    monkeypatch.setattr(common, "LINES", 10)
    n = common.line_tasks(spark, str(tmp_path))
    assert n == -(-len(lines) // 10)
    every = common.co_bought(spark, str(tmp_path))
    pairs = {(a, b) for o, a in lines for q, b in lines if o == q and a != b}
    assert every.rdd.getNumPartitions() == n and sorted(tuple(r) for r in every.collect()) == sorted(pairs)
    inside = common.co_bought(spark, str(tmp_path), groups).collect()
    assert sorted(tuple(r) for r in inside) == sorted((a, b) for a, b in pairs if 3 not in (a, b) and a % 2 == b % 2)


def test_one_way_links_once_in_few_tasks(spark):
    from termloom.operators import graph as G

    e = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 1), (3, 1), (4, 4), (None, 5)], "src long, dst long")
    got = G.asymmetric(e, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(3, 1), (None, 5)] and got.rdd.getNumPartitions() == 3
    once = G.undirected(e.withColumn("src_ord", F.col("src")).withColumn("pos", F.lit(0)), tasks=3)
    assert sorted(tuple(r) for r in once.collect()) == [(1, 2), (3, 1)] and once.rdd.getNumPartitions() == 3


def test_pieces_settled_in_a_task_are_as_by_rounds(spark):
    """Circles, chains and lone terms, in tasks, by rounds of joins, and some of each."""
    from termloom.operators import roadmap as R

    rng = random.Random(11)
    n = 60
    levels = spark.createDataFrame([(i % 2, f"t{i:02d}", i, rng.choice([1, 2, 3, None])) for i in range(n)], "grp int, slug string, term_ord int, difficulty int")
    block = lambda i: i // 2 // 7 * 14
    needs = [(i, block(i) + 2 * rng.randrange(7) + i % 2) for i in range(50) for _ in range(i % 3)] + [(0, 99), (3, 3)]
    needs = spark.createDataFrame([(f"t{a:02d}", f"t{b:02d}") for a, b in needs], "src string, dst string")
    ways = [sorted(tuple(r) for r in R.topological_order(levels, needs, p).collect()) for p in (1, 4, 65_536)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == n


def test_refilling_in_steps_of_few_kinds(spark):
    from termloom.operators import graph as G
    from tests.test_partners import all_pairs, dictionary, lists, refill

    t = dictionary(spark, 7, 24)
    rows = sorted(t.collect(), key=lambda r: r["term_ord"])
    links = spark.createDataFrame([], "src string, dst string, pos long")
    assert lists(G.refilled(t, links, stretch_kinds=9)) == refill(all_pairs(rows), {r["slug"]: [] for r in rows})


def test_few_texts_a_batch(spark):
    """The bound holds where the session has not set the number, and a number of the session's own stays."""
    from termloom.operators import matching as M

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    try:
        for own, want in ((None, "1000"), ("77", "77")):
            spark.conf.unset(name) if own is None else spark.conf.set(name, own)
            assert M.word_table(docs).count() == 3 and spark.conf.get(name) == want
    finally:
        spark.conf.unset(name)


def test_question_timer_keeps_states_by_buckets(spark, tmp_path):
    """states and timers go with the buckets, not with the users; ids beyond 2^53, no user and no question come through beside each other."""
    from termloom.streaming import state as ST

    big = (1 << 53) + 1
    users = [None, *(big + i for i in range(300))]
    rows = [(2 * i, u, None if i % 7 == 0 else big + i, True, i % 5 + 1) for i, u in enumerate(users)] + [(2 * i + 1, u, None, False, i % 5 + 11) for i, u in enumerate(users) if i % 3 == 0]
    df = spark.createDataFrame(rows, "event_id long, user_id long, question long, shown boolean, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = ST.question_timer(stream, buckets=8).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).start()
    try:
        q.processAllAvailable()
        states = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        spark.createDataFrame([(-1, 7, 0, False)], "event_id long, user_id long, question long, shown boolean").withColumn("ts", F.timestamp_seconds(F.lit(10_000))).write.mode("append").parquet(source)
        q.processAllAvailable()
    finally:
        q.stop()
    want = [(u, None if i % 7 == 0 else big + i, i % 5 + 1, "answered" if i % 3 == 0 else "timed_out", i % 5 + (11 if i % 3 == 0 else 16)) for i, u in enumerate(users)]
    got = spark.read.parquet(out).select("user_id", "question", F.unix_seconds("shown_at"), "outcome", F.unix_seconds("ended_at")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < max(states) <= 4 * 8  # a value and the timer's rows for each bucket


def test_partners_of_one_kind_are_written_out_in_bounded_tasks(spark, monkeypatch):
    """terms of one kind, or links, are dealt to as many tasks as they ask for."""
    from termloom.operators import graph as G

    monkeypatch.setattr(G, "ROWS", 10)
    t = spark.range(60).select(
        F.format_string("t%02d", "id").alias("slug"), F.lit("").alias("title_ko"), F.lit("old ring").alias("title_en"), F.lit("a ring").alias("definition"), F.array(F.lit("c")).alias("categories"))
    best = G.kept(G.best_pairs(t, 3))
    want = {(f"t{i:02d}", f"t{j:02d}", r + 1) for i in range(60) for r, j in enumerate([j for j in range(4) if j != i][:3])}
    assert {(r["src"], r["dst"], r["rank"]) for r in best.collect()} == want
    assert G.best_pairs(t, 3).rdd.getNumPartitions() == 6
    mutual = G.mutual_top(best, G.tasks_over(best))
    assert mutual.rdd.getNumPartitions() == 18
    assert {(r["src"], r["dst"]) for r in mutual.collect()} == {(a, b) for a, b, _ in want if (b, a) in {w[:2] for w in want}}


def test_groups_that_fit_a_task_take_no_rounds(spark, monkeypatch):
    """One linked piece that fills its group, a group of several pieces and terms without a group: places are the same by whole groups, by pieces
    and by rounds, and whole groups need no labels."""
    from termloom.operators import roadmap as R

    rng = random.Random(12)
    levels = spark.createDataFrame([(g, f"{g}{i}", i, rng.choice([1, 2, 3, None])) for g, n in (("a", 40), ("b", 25), (None, 4)) for i in range(n)], "grp string, slug string, term_ord int, difficulty int")
    links = [("a", rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [("b", i, i // 5 * 5 + rng.randrange(5)) for i in range(25)]
    needs = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", 0) for g, i, j in links], "src string, dst string, pos int")
    places = lambda piece: sorted(((r["grp"] or "", r["slug"], r["place"]) for r in R.topological_order(levels, needs, piece).collect()))
    by_rounds, by_pieces, mixed = places(1), places(39), places(30)
    monkeypatch.setattr(R, "_least_before", None)
    whole = places(R.PIECE)
    assert len(whole) == 69 and whole == by_rounds == by_pieces == mixed


def test_lines_are_gone_through_once_for_lists_of_links(spark):
    """What reads the terms of the lists again does not read the lines again, and a step of refilling takes 524,288 terms."""
    from termloom.operators import graph as G
    from termloom.plans import validation

    t = validation.graph_terms(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in t.inputFiles()) and t.count() == 200
    assert G.STRETCH == 524_288


def test_a_step_of_refilling_over_numbers():
    """Terms served in input order: room used up on the way, a partner that already leads to the term, a list that ends."""
    import pyarrow as pa

    from termloom.operators import graph as G

    members = pa.table({"at": pa.array([2, 1, 3, 4], pa.int64()), "slug": ["b", "a", "c", "d"], "sig": ["x", "x", "y", "z"], "z": pa.array([1, 2, 0, 2], pa.int32()), "links": [["e"], ["e", "q"], [], ["a", "b"]]})
    lists = pa.table({"sig": ["x", "x", "x", "y", "y", "z"], "rank": pa.array([3, 1, 2, 1, 2, 1], pa.int32()), "dst": ["b", "e", "f", "e", "f", "f"], "z": pa.array([1, 3, 3, 3, 3, 3], pa.int32()), "whole": [True, True, True, True, True, False]})
    got = [tuple(r.values()) for r in G._served(members, lists).to_pylist()]
    # a takes f, b takes f, which is full then; c takes e alone; d finds f full on a list that was cut.
    assert got == [("a", "f", 1, 0), ("b", "f", 2, 0), ("c", "e", 3, 0), (None, None, 3, 0)]
