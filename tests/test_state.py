"""Ledgers, quiz, streaming twins, sources and sinks."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import extract as E
from termloom.operators import ledger as L
from termloom.operators import quality as Q
from termloom.operators import quiz as Z
from termloom.sources import readers, sinks
from termloom.streaming import state as ST

T0 = dt.datetime(2026, 1, 1)


def attempts(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), T0 + dt.timedelta(seconds=37 * i), rng.random() < 0.8) for i in range(400)]
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, bad boolean")


def locked(rows, most=5, minutes=5):
    out = []
    for u in {r[1] for r in rows}:
        n, until = 0, None
        for _, _, ts, bad in sorted((r for r in rows if r[1] == u), key=lambda r: r[2]):
            n, until, hit = ST.lockout_step(n, until, int(pd.Timestamp(ts).value // 1000), bad, most, minutes * 60_000_000)
            if hit:
                out.append((u, ts))
    return sorted(out)


def test_lockouts_batch_and_stream(spark, tmp_path):
    rows, df = attempts(spark)
    got = sorted((r["user_id"], r["locked_at"]) for r in L.lockouts(df, "user_id", F.col("bad")).collect())
    assert got == locked(rows) and got
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ST.lockouts(stream.select("user_id", "ts", "bad")).writeStream.format("memory").queryName("locks").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user_id"], r["locked_at"]) for r in spark.table("locks").collect()) == got


def test_upserts_stream(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, value string"
    batches = [[(1, 1, T0, "a"), (2, 2, T0, "b")], [(3, 1, T0 + dt.timedelta(1), "c")], [(4, 3, T0, "d")], [(5, 2, T0 + dt.timedelta(2), "e"), (6, 9, T0, None)]]
    want = {}
    for i, rows in enumerate(batches):
        want |= {r[1]: r[3] for r in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # From the third batch on, the stream starts over with a new checkpoint: it goes on from the table.
        q = ST.upserts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), ["user_id"], str(tmp_path / f"c{i > 1}"), buckets=4)
        q.processAllAvailable()
        q.stop()
        rows = ST.upserted(spark, str(tmp_path / "t"), schema).collect()
        assert {r["user_id"]: r["value"] for r in rows} == want and len(rows) == len(want)
    assert len([p for p in (tmp_path / "t/versions").iterdir() if p.is_dir()]) <= 3


def test_session_windows(spark):
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    keys = spark.createDataFrame([(1, ms(0), "a"), (1, ms(100), "ab"), (1, ms(400), "abc"), (2, ms(0), "x")], "user_id long, ts timestamp, value string")
    assert sorted((r["user_id"], r["value"]) for r in ST.typing_bursts(keys, "user_id").collect()) == [(1, "ab"), (1, "abc"), (2, "x")]
    searches = spark.createDataFrame([("s", "ab", 0, ms(0)), ("s", "abc", 3, ms(300)), ("s", "zz", 0, ms(5000)), ("s", "q", 0, ms(9000))], "session_id string, query string, result_count int, ts timestamp")
    assert [r["query"] for r in ST.unanswered_searches(searches).collect()] == ["zz"]


def test_debounce(spark):
    rows = [(i, 1, T0 + dt.timedelta(milliseconds=t)) for i, t in enumerate((0, 100, 300, 310, 900))]
    got = L.debounced(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), "user_id", "150 milliseconds")
    assert sorted(r["event_id"] for r in got.collect()) == [1, 3, 4]


def test_ledger(spark):
    e = spark.createDataFrame([(1, 1, "a", T0), (2, 1, "b", T0), (3, 2, "a", T0)], "event_id long, user_id long, item string, ts timestamp")
    assert {(r["user_id"], r["item"]) for r in L.latest(e, ["user_id"]).collect()} == {(1, "b"), (2, "a")}
    assert L.owned(e, 1).count() == 2
    assert {r["user_id"]: r["on"] for r in L.toggled(e, ["user_id"]).collect()} == {1: False, 2: True}
    assert L.live(e, ["user_id"], F.col("item") == "b").count() == 1
    marks = spark.createDataFrame([(1,), (2,)], "bookmark_id long")
    tags = spark.createDataFrame([(1, "x", T0), (1, "y", T0 + dt.timedelta(1))], "bookmark_id long, tag string, created_at timestamp")
    both = L.with_tags(marks, tags)
    assert [r["tags"] for r in both.orderBy("bookmark_id").collect()] == [["x", "y"], []]
    assert L.tagged(both, ["y"]).count() == 1 and L.tagged(both, []).count() == 2
    assert L.cascade(tags, marks.filter("bookmark_id = 2"), "bookmark_id").count() == 0
    ok = spark.createDataFrame([("a",), (" ",), ("x" * 31,)], "t string").select(L.valid_tag(F.col("t")).alias("v"))
    assert [r["v"] for r in ok.collect()] == [True, False, False]


def test_streaks(spark):
    rows = [(i, 1, T0 + dt.timedelta(seconds=i), g) for i, g in enumerate([1, 1, 0, 1, 1, 1])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, good int")
    assert [r["streak"] for r in L.streaks(df, "user_id", F.col("good") == 1, ["ts"]).orderBy("event_id").collect()] == [1, 2, 0, 1, 2, 3]
    r = L.quiz_totals(df, "user_id", F.col("good") == 1, ["ts"]).first()
    assert (r["played"], r["correct"], r["accuracy"], r["best_streak"], r["missed"]) == (6, 5, 83, 3, 1)
    # A time-out cuts the streak and is missed, but not played.
    r = L.quiz_totals(df, "user_id", F.col("good") == 1, ["ts"], F.col("event_id") == 4).first()
    assert (r["played"], r["correct"], r["accuracy"], r["best_streak"], r["missed"]) == (5, 4, 80, 2, 2)
    assert L.quiz_totals(df, "user_id", F.col("good") == 1, ["ts"], F.lit(True)).first()["accuracy"] == 0


def test_quiz_options(spark):
    asked = spark.createDataFrame([(f"s{i}", f"o{i % 6}") for i in range(30)], "slug string, answer string")
    got = Z.distractors(asked, asked.select(F.col("answer").alias("option")), seed=1).join(asked, "slug").collect()
    by = {}
    for r in got:
        assert r["option"] != r["answer"]
        by.setdefault(r["slug"], set()).add(r["option"])
    assert len(by) == 30 and all(len(v) == 3 for v in by.values())
    wide = spark.createDataFrame([(f"x{i}",) for i in range(3000)], "option string")
    drawn = Z.distractors(spark.createDataFrame([(f"q{i}", f"x{i}") for i in range(600)], "slug string, answer string"), wide, seed=2)
    assert drawn.count() == 1800 and drawn.select("option").distinct().count() > 1000
    few = Z.distractors(asked, spark.createDataFrame([("o0",), ("o1",)], "option string"), seed=1)
    assert few.filter("slug = 's0'").count() == 1
    assert Z.questions(asked, 50, 1).count() == 30 and Z.questions(asked, 4, 1).count() == 4


@pytest.mark.parametrize("text,safe,reason", [("hello", True, None), ("<SCRIPT>x", False, "xss"), ("aaaaaaaaaa", False, "spam"), ("a a a a b a", False, "spam"), (None, True, None), ("it's <b>", True, None)])
def test_input_validation(spark, text, safe, reason):
    r = spark.createDataFrame([(text,)], "t string").select(T.validate_user_input(F.col("t")).alias("v")).first()["v"]
    assert (r["safe"], r["reason"]) == (safe, reason)
    if text == "it's <b>":
        assert r["value"] == "it&#039;s &lt;b&gt;"


def test_spelling_key(spark):
    df = spark.createDataFrame([("Ｔ－test (A)",), ("t-test・a",), (None,)], "t string").select(T.spelling_key(F.col("t")).alias("k"))
    keys = [r["k"] for r in df.collect()]
    assert keys[1] == "ttesta" and keys[2] == "" and keys[0].startswith("t")


PAGE = """<html><head></head><body><h1>A <b>점검</b></h1><strong>한 줄 정의:</strong> 짧은 <i>점검</i> "단계".
<div class="related-terms"><a href="b-check.html">B</a><a href="../terms/c-check.html?x=1#y">C</a><a href="b-check.html">B</a><a href="c.pdf">p</a></div></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, "a-check", PAGE), (2, "bare", "<p>x</p>"), (3, "old", '<meta http-equiv="refresh" content="0; url=/terms/new-one.html?x">')], "page_id int, slug string, html string")
    rows = df.select("page_id", E.related_slugs(F.col("html")).alias("r"), E.title(F.col("html"), F.col("slug")).alias("t"), E.definition(F.col("html")).alias("d"), E.redirect_target(F.col("html")).alias("to")).orderBy("page_id").collect()
    assert rows[0]["r"] == ["b-check", "c-check"] and rows[0]["t"] == "A 점검" and rows[0]["d"] == '짧은 점검 "단계".'
    assert rows[1]["r"] == [] and rows[1]["t"] == "bare" and rows[1]["to"] is None and rows[2]["to"] == "new-one"
    merged = spark.createDataFrame([(["a"], ["b", "a", "me"], "me"), (None, ["x"], "me")], "o array<string>, n array<string>, s string")
    assert [r["m"] for r in merged.select(E.merged_related(F.col("o"), F.col("n"), F.col("s")).alias("m")).collect()] == [["a", "b"], ["x"]]


def test_block_upsert_is_idempotent(spark):
    step = lambda c: E.upsert_block(c, "<!--a-->", "<!--/a-->", "$1\\x", "</head>")
    df = spark.createDataFrame([("<head></head>",), ("no anchor",), ("<head><!--a-->old<!--/a--></head>",)], "html string")
    once = df.select(step(F.col("html")).alias("a"))
    rows = once.select("a.outcome", "a.html", step(F.col("a.html")).alias("b")).collect()
    assert [r["outcome"] for r in rows] == ["added", "no-anchor", "replaced"]
    assert all(r["b"]["html"] == r["html"] for r in rows) and rows[2]["html"] == "<head><!--a-->$1\\x<!--/a--></head>"
    cut = df.select(E.strip_block(F.col("html"), "<!--a-->.*?<!--/a-->", ["anchor"]).alias("h")).collect()
    assert cut[2]["h"] == "<head></head>" and cut[1]["h"] == "no anchor"


def test_template_choice(spark):
    pages = spark.createDataFrame([(1, "m", "gold coin"), (2, "m", "none"), (3, "", "gold")], "page_id int, html string, title string")
    keys = spark.createDataFrame([("t2", 1, "coin", 0), ("t1", 0, "gold", 0)], "template string, tmpl_ord int, keyword string, kw_ord int")
    assert [(r["page_id"], r["template"]) for r in E.first_template(pages, keys, F.col("title"), ["m"]).collect()] == [(1, "t1")]


TERM = "slug string, title_ko string, title_en string, definition string, categories array<string>, subcategory string, aliases array<string>, related array<string>"


def test_quality_rules(spark):
    t = spark.createDataFrame([
        ("a", "가나", "A b", "d" * 30, ["x"], "s1", ["al"], ["b", "gone", "a"]), ("b", "가 나", "ab", "short", ["x"], "bad", [], ["a", "a"]),
        ("c-d", "가나", "c-d", None, ["x", "zz"], "", None, None), ("E", "Long English title here ok", "123", "", [], None, None, ["a"]),
    ], TERM)
    found = lambda df: {(r["rule"], r["key"], r["detail"]) for r in df.collect()}
    assert ("missing field", "E", "categories") in found(Q.missing_fields(t, ["slug", "categories", "definition"]))
    assert found(Q.bad_slugs(t)) == {("slug format", "E", None)}
    assert found(Q.unknown_categories(t, spark.createDataFrame([("x",)], "category string"))) == {("unknown category", "c-d", "zz")}
    assert found(Q.wrong_subcategory(t, spark.createDataFrame([("x", "s1")], "category string, subcategory string"))) == {("wrong subcategory", "b", "bad")}
    assert found(Q.broken_links(t)) == {("broken link", "a", "gone"), ("self link", "a", "a")}
    assert found(Q.english_titles(t)) == {("slug as english title", "c-d", "c-d"), ("english title without letters", "E", "123")}
    assert found(Q.korean_titles(t)) == {("korean title missing", "E", "Long English title here ok")}
    assert found(Q.same_title(t)) == {("same title in category", "가나", "a, c-d")}
    assert found(Q.spelling_drift(t, "title_ko")) == {("spelling drift in title_ko", "가나", "가 나 / 가나")}
    assert found(Q.translation_drift(t)) == {("several translations", "가나", "2")}
    assert ("short definition", "b", "5") in found(Q.thin_entries(t))
    rules = {(r[0], r[1], r[2]) for r in found(Q.edge_rules(t))}
    assert {("repeated related term", "b", "a"), ("self link", "a", None), ("unknown related term", "a", "gone"), ("no related terms", "c-d", None), ("unanswered link", "E", "a")} <= rules
    pages = spark.createDataFrame([("a", "<h2>x</h2>"), ("zzz", "")], "slug string, html string")
    assert {("not in pages", "b", None), ("not in terms", "zzz", None), ("no section", "a", None)} <= found(Q.page_rules(t, pages, {"no section": "<h2>y</h2>"}))
    rep = {r["rule"]: (r["n"], r["more"]) for r in Q.report(Q.broken_links(t), 1).collect()}
    assert rep == {"broken link": (1, 0), "self link": (1, 0)}


def test_aliases(spark):
    t = spark.createDataFrame([("a", "상관 계수(r값)", "Analysis of Variance", ["x"]), ("b", "다른", "Any Vector", []), ("c", "anova", "Item Response Theory (IRT)", None)], "slug string, title_ko string, title_en string, aliases array<string>")
    got = {r["slug"]: r["aliases"] for r in Q.new_aliases(t).collect()}
    assert got["a"] == sorted(["상관 계수", "r값", "상관계수(r값)", "상관계수"]) and got["c"] == ["IRT"] and "b" not in got


def test_batch_merge(spark):
    have = spark.createDataFrame([("old",)], "slug string")
    pages = spark.createDataFrame([("old",), ("new",)], "slug string")
    batch = spark.createDataFrame([("old", "t", 0), ("new", None, 1), ("nopage", "t", 2), ("new", "t", 3), ("new", "u", 4)], "slug string, title string, ord int")
    got = [r["fate"] for r in Q.merge_batch(have, batch, pages, ["slug", "title"]).orderBy("ord").collect()]
    assert got == ["already there", "missing fields", "no page", "accepted", "repeated in batch"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"slug": "b", "categories": ["x"], "related": ["a"]},\n {"slug": "a", "title_ko": "가 & 나", "categories": ["y", "x"]}]')
    (tmp_path / "bad.json").write_text('{"slug": "b"}')
    terms = readers.read_terms(spark, str(tmp_path / "t.json"))
    assert [(r["slug"], r["term_ord"]) for r in terms.orderBy("term_ord").collect()] == [("b", 0), ("a", 1)]
    with pytest.raises(ValueError):
        readers.read_terms(spark, str(tmp_path / "bad.json"))
    assert readers.with_defaults(terms).filter("size(aliases) = 0").count() == 2
    big = readers.numbered(spark.range(0, 1000, 1, 7))
    assert sorted(r["term_ord"] for r in big.collect()) == list(range(1000)) and big.filter("id <> term_ord").count() == 0
    for i, m in enumerate(('{"a": "1", "b": "1"}', '{"b": "2"}')):
        (tmp_path / f"m{i}.json").write_text(m)
    maps = readers.read_maps(spark, [str(tmp_path / f"m{i}.json") for i in range(2)])
    assert {r["key"]: r["value"] for r in maps.collect()} == {"a": "1", "b": "2"}
    (tmp_path / "site/terms").mkdir(parents=True)
    (tmp_path / "site/node_modules").mkdir()
    for p in ("terms/x.html", "node_modules/y.html", "terms/z.txt"):
        (tmp_path / "site" / p).write_text("<h1>x</h1>")
    assert [r["slug"] for r in readers.read_pages(spark, str(tmp_path / "site")).collect()] == ["x"]
    items = spark.createDataFrame([(1, 1, 0, "c"), (1, 0, 1, "b"), (1, 0, 0, "a"), (2, 0, 0, " ")], "doc_id int, page int, item int, text string")
    assert {r["doc_id"]: r["text"] for r in readers.page_text(items).collect()} == {1: "a b\nc", 2: ""}
    assert {r["doc_id"]: r["has_text"] for r in readers.has_text(items).collect()} == {1: True, 2: False}
    fixed = readers.map_update(terms, spark.createDataFrame([("a", "sub")], "slug string, value string"), "subcategory", strict=True)
    assert {r["slug"]: r["subcategory"] for r in fixed.collect()} == {"a": "sub", "b": None}
    with pytest.raises(ValueError):
        readers.map_update(terms, spark.createDataFrame([("zz", "s")], "slug string, value string"), "subcategory", strict=True)
    stored = spark.createDataFrame([('["a","b"]',), ("{oops",), (None,)], "raw string").select(readers.stored_list("raw").alias("v"))
    assert [r["v"] for r in stored.collect()] == [["a", "b"], [], []]
    moved = readers.resolve_redirects(spark.createDataFrame([("o",), ("k",)], "slug string"), spark.createDataFrame([("o", "n")], "from_slug string, to_slug string"))
    assert {r["slug"] for r in moved.collect()} == {"n", "k"}

    sinks.write_by_category(terms, str(tmp_path / "cat"))
    assert {p.name for p in (tmp_path / "cat").iterdir() if p.is_dir()} == {"primary_category=x", "primary_category=y"}
    pages = spark.createDataFrame([(0, "index.html", T0), (1, "terms/a b.html", T0)], "ord long, path string, modified timestamp")
    assert sinks.write_sitemap(pages, "https://example.org/", str(tmp_path / "map")) == 2
    text = [r["value"] for r in spark.read.text(str(tmp_path / "map")).collect()]
    assert any("https://example.org/terms/a%20b.html" in x and "2026-01-01" in x for x in text)
    feed = spark.createDataFrame([(f"s{i}", "T & t", "x", T0 + dt.timedelta(i), i) for i in range(40)], "slug string, title string, text string, added timestamp, term_ord int")
    got = sinks.feed_items(feed, "https://example.org").collect()
    assert len(got) == 30 and got[0]["slug"] == "s39" and "T &amp; t" in got[0]["xml"] and "GMT" in got[0]["xml"]
    en = terms.withColumn("definition_en", F.when(F.col("slug") == "a", "An <x>"))
    html = {r["slug"]: r["html"] for r in sinks.english_pages(en).collect()}
    assert "An &lt;x&gt;" in html["a"] and "pending" in html["b"]
    assert tuple(sinks.english_index(en).first()) == (1, 2)
    links = spark.createDataFrame([("b", "a", 0)], "src string, dst string, pos int")
    assert "가 &amp; 나" in sinks.related_block(links, terms).first()["html"]
    with pytest.raises(Exception):
        sinks.related_block(spark.createDataFrame([("b", "nope", 0)], "src string, dst string, pos int"), terms).collect()
    graph = sinks.subgraphs(terms.select(F.lit("g").alias("grp"), "term_ord", "slug", F.col("title_ko").alias("title")), links.withColumn("grp", F.lit("g"))).first()
    assert len(graph["nodes"]) == 2 and graph["edges"] == [["b", "a"]]


def test_array_in_parts(spark, tmp_path):
    """Arrays a line an object are read in parallel, in order, whatever their files; other layouts and bad ones as before."""
    n = 500
    t = spark.range(n).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("slug"), F.lit('x "y", [z]').alias("definition"), (F.col("id") * 3 - 7).alias("term_ord")).repartition(5)
    for name, put in (("a", sinks.write_array), ("b", sinks.write_pretty)):
        put(t, str(tmp_path / name))
        got = [(r["slug"], r["term_ord"]) for r in readers.read_terms(spark, str(tmp_path / name)).orderBy("term_ord").collect()] if name == "a" else None
        assert got is None or got == [(f"t{i}", i) for i in range(n)]
        text = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        import json

        assert [x["slug"] for x in json.loads(text)] == [f"t{i}" for i in range(n)]
        (tmp_path / f"{name}.json").write_text(text)
        assert [r["slug"] for r in readers.read_terms(spark, str(tmp_path / f"{name}.json")).orderBy("term_ord").collect()] == [f"t{i}" for i in range(n)]
    (tmp_path / "one.json").write_text('[\n  {"slug": "q"}\n]\n')
    (tmp_path / "none.json").write_text("[\n]\n")
    (tmp_path / "twisted.json").write_text('{"slug": "q"}\n[\n]\n')
    assert readers.read_terms(spark, str(tmp_path / "one.json")).first()["slug"] == "q"
    assert readers.read_terms(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        readers.read_terms(spark, str(tmp_path / "twisted.json"))
    with pytest.raises(ValueError):
        sinks.write_array(t.withColumn("term_ord", F.lit(1)), str(tmp_path / "ties"))


def test_map_in_parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", None if i == 3 else f'v "{i}",') for i in range(50)], "key string, value string")
    sinks.write_map(rows, str(tmp_path / "m"))
    import json

    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert json.loads(text) == {r["key"]: r["value"] for r in rows.collect()}
    (tmp_path / "late.json").write_text('{\n  "k1": "new",\n  "k1": "newest"\n}\n')
    got = {r["key"]: r["value"] for r in readers.read_maps(spark, [str(tmp_path / "m"), str(tmp_path / "late.json")]).collect()}
    assert got == json.loads(text) | {"k1": "newest"}


def test_repeated_updates_and_redirects(spark):
    terms = spark.createDataFrame([("a", "x"), ("b", "y")], "slug string, subcategory string")
    twice = spark.createDataFrame([("a", "1", 2), ("a", "2", 1)], "slug string, value string, ord int")
    assert sorted(map(tuple, readers.map_update(terms, twice, "subcategory").collect())) == [("a", "1"), ("b", "y")]
    r = spark.createDataFrame([("a", "m"), ("a", "n")], "from_slug string, to_slug string")
    assert [x["slug"] for x in readers.resolve_redirects(terms, r).orderBy("slug").collect()] == ["b", "n"]


def test_sitemap_files_and_index(spark, tmp_path):
    pages = spark.range(25).select(F.col("id").alias("ord"), F.concat(F.lit("terms/a&b "), F.col("id").cast("string")).alias("path"), F.lit(T0).cast("timestamp").alias("modified"))
    assert sinks.write_sitemap(pages, "https://example.org", str(tmp_path / "map"), most=4) == 25
    files = [p for p in (tmp_path / "map").iterdir() if p.name.startswith("part-")]
    assert len(files) >= 7 and all(p.read_text().count("<url>") <= 4 and "<urlset xmlns=" in p.read_text() for p in files)
    index = "".join(p.read_text() for p in (tmp_path / "map_index").iterdir() if p.name.startswith("part-"))
    assert all(f"https://example.org/{p.name}" in index for p in files if "<url>" in p.read_text())
    assert sinks.read_sitemap(spark, str(tmp_path / "map")).filter("loc like '%/terms/a%26b%20%'").count() == 25


def test_subgraphs_in_chunks(spark, tmp_path):
    nodes = spark.range(25).select(F.lit("g").alias("grp"), F.col("id").alias("term_ord"), F.format_string("t%02d", "id").alias("slug"), F.lit("x").alias("title"))
    edges = spark.range(24).select(F.lit("g").alias("grp"), F.format_string("t%02d", "id").alias("src"), F.format_string("t%02d", F.col("id") + 1).alias("dst"))
    got = {r["chunk"]: (len(r["nodes"]), len(r["edges"])) for r in sinks.subgraphs(nodes, edges, 10).collect()}
    assert got == {0: (10, 10), 1: (10, 10), 2: (5, 4)}


def test_finding_names_some(spark):
    t = spark.range(30).select(F.format_string("s%02d", "id").alias("slug"), F.lit("T").alias("title_ko"), F.array(F.lit("c")).alias("categories"))
    r = Q.same_title(t).first()
    assert r["detail"].startswith("s00, s01") and r["detail"].endswith("s19 and 10 more")


def test_history_from_a_log(spark, tmp_path):
    (tmp_path / "log").write_text("commit a1\nAuthor: x\nDate: 2026-01-02T00:00:00\n\nb.html\nsub dir/a.html\n\ncommit a0\nDate: 2025-01-01T00:00:00\n\nb.html\ncommit zz\nDate: nonsense\n\nc.html\n")
    got = sorted((r["path"], str(r["ts"].date())) for r in readers.read_history(spark, str(tmp_path / "log")).collect())
    assert got == [("b.html", "2025-01-01"), ("b.html", "2026-01-02"), ("sub dir/a.html", "2026-01-02")]
