"""Bookmarks, flash cards, quizzes, search logs and daily picks over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import ledger as L
from termloom.operators import quiz as Z
from termloom.operators import sampling
from termloom.operators.graph import grouped
from termloom.plans.common import RETURNED_PARTS, part_terms, returned_parts, table
from termloom.streaming import state as ST


def _keyed(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


_KEYED = "SELECT *, (props::JSON->>'k')::INT AS k FROM events"


def bookmark_terms(spark, sf_dir):
    """Clicks as bookmarks of customers, the last of each user and key: with the customer's name, null past the table's end."""
    marks = L.latest(_keyed(spark, sf_dir).filter("event_type = 'click'"), ["user_id", "k"]).select("user_id", (F.col("k") * F.col("k")).cast("long").alias("slug"))
    terms = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("title_en"), F.array("c_mktsegment").alias("categories"))
    every = L.with_terms(marks, terms).select("user_id", "slug", "title_en", F.lit("all").alias("which"))
    return every.unionByName(L.with_terms(marks, terms, "BUILDING").select("user_id", "slug", "title_en", F.lit("BUILDING").alias("which")))


BOOKMARK_TERMS = f"""WITH m AS (SELECT DISTINCT user_id, (k * k)::BIGINT AS slug FROM ({_KEYED}) WHERE event_type = 'click')
SELECT user_id, slug, c_name AS title_en, 'all' AS which FROM m LEFT JOIN customer ON c_custkey = slug
UNION ALL SELECT user_id, slug, c_name, 'BUILDING' FROM m JOIN customer ON c_custkey = slug WHERE c_mktsegment = 'BUILDING'"""


def history_list(spark, sf_dir):
    """Every user's events from the newest."""
    return L.newest_first(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "place")


HISTORY_LIST = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events"


def own_rows(spark, sf_dir):
    """What user 8 may read."""
    return L.owned(table(spark, sf_dir, "events"), 8).select("event_id", "user_id", "event_type")


OWN_ROWS = "SELECT event_id, user_id, event_type FROM events WHERE user_id = 8"


def valid_records(spark, sf_dir):
    """Tags of a length that follows the key, and event types as judgements."""
    e = _keyed(spark, sf_dir).withColumn("tag", F.expr("repeat(' ', cast(value as int) % 2) || repeat('x', k - 60)"))
    status = F.when(F.col("event_type") == "click", "known").when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type"))
    return e.select("event_id", L.valid_tag(F.col("tag")).alias("tag_ok"), L.valid_status(status).alias("status_ok"))


VALID_RECORDS = f"""WITH t AS (SELECT *, repeat(' ', trunc(value)::INT % 2) || repeat('x', greatest(k - 60, 0)) AS tag FROM ({_KEYED}))
SELECT event_id, trim(tag) <> '' AND length(tag) <= 30 AS tag_ok, event_type IN ('click', 'error') AS status_ok FROM t"""


def cascaded_tags(spark, sf_dir):
    """Tags (views) of bookmarks (user and key) whose last event is no error."""
    e = _keyed(spark, sf_dir).withColumn("mark", F.concat_ws("-", "user_id", "k"))
    live = L.live(e, ["mark"], F.col("event_type") == "error")
    return L.cascade(e.filter("event_type = 'view'"), live, "mark").select("event_id", "mark")


CASCADED_TAGS = f"""WITH e AS (SELECT *, user_id || '-' || k AS mark FROM ({_KEYED})), l AS (
  SELECT mark FROM (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY ts DESC, event_id DESC) AS i FROM e) WHERE i = 1 AND event_type <> 'error'
) SELECT event_id, mark FROM e WHERE event_type = 'view' AND mark IN (SELECT mark FROM l)"""


def quiz_best_scores(spark, sf_dir):
    """Days as sessions, clicks as right answers."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return L.quiz_scores(e, "user_id", "day", F.col("event_type") == "click")


QUIZ_BEST_SCORES = """WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS d, count(*) FILTER (event_type = 'click') AS s FROM events GROUP BY 1, 2)
SELECT user_id, max(s) AS best_score, count(*) AS n_sessions FROM s GROUP BY 1"""


def quiz_retry(spark, sf_dir):
    """Keys that a user missed, by an error or after a time-out (value of 90 or more)."""
    return L.retry_questions(_keyed(spark, sf_dir), "user_id", "k", (F.col("event_type") != "error") & (F.col("value") < 90), "ts", "event_id")


QUIZ_RETRY = f"""SELECT user_id, k, arg_min(event_id, (ts, event_id)) AS first_missed FROM ({_KEYED}) WHERE event_type = 'error' OR value >= 90 GROUP BY 1, 2"""


def _judged(spark, sf_dir):
    """Nations as cards, regions as decks; a session is a user's day."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("card"), F.col("n_regionkey").alias("deck"))
    e = _keyed(spark, sf_dir).filter("event_type in ('click', 'error')").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor(F.col("k") / 4).cast("int").alias("card"), "ts", "event_id",
        F.when(F.col("event_type") == "click", L.KNOWN).otherwise(L.UNKNOWN).alias("status"))
    return n, L.judged(e.join(n, "card"), ["user_id", "day", "deck"], "card")


_JUDGED = f"""j AS (
  SELECT user_id, day, n_regionkey AS deck, card, status FROM (
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, k // 4 AS card, CASE event_type WHEN 'click' THEN 'known' ELSE 'unknown' END AS status,
           row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d'), k // 4 ORDER BY ts DESC, event_id DESC) AS i
    FROM ({_KEYED}) WHERE event_type IN ('click', 'error')) JOIN nation ON n_nationkey = card WHERE i = 1
)"""


def flashcard_counts(spark, sf_dir):
    _, last = _judged(spark, sf_dir)
    return L.judgement_counts(last, ["user_id", "day", "deck"])


FLASHCARD_COUNTS = f"""WITH {_JUDGED} SELECT user_id, day, deck, count(*) FILTER (status = 'known') AS n_known, count(*) FILTER (status = 'unknown') AS n_unknown FROM j GROUP BY ALL"""


def flashcard_decks(spark, sf_dir):
    n, last = _judged(spark, sf_dir)
    return L.study_deck(n, last, ["user_id", "day"], "deck", "card")


FLASHCARD_DECKS = f"""WITH {_JUDGED}, f AS (SELECT user_id, day, deck FROM j GROUP BY ALL HAVING count(*) FILTER (status = 'unknown') = 0)
SELECT user_id, day, deck, card FROM j WHERE status = 'unknown'
UNION ALL SELECT user_id, day, deck, n_nationkey FROM f JOIN nation ON n_regionkey = deck"""


def quiz_scope(spark, sf_dir):
    """Questions on parts that mostly came back: the scope that another page hands over."""
    scope = returned_parts(spark, sf_dir).select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("slug"))
    return Z.in_scope(part_terms(spark, sf_dir), scope).select("slug", "title_en")


QUIZ_SCOPE = f"SELECT 'part-' || p_partkey AS slug, p_name AS title_en FROM part WHERE p_partkey IN {RETURNED_PARTS}"


def quiz_questions(spark, sf_dir):
    """Twenty questions in a seeded order, or fewer where there are not so many parts."""
    return Z.questions(part_terms(spark, sf_dir), 20, 11).select("slug", "place")


QUIZ_QUESTIONS = """SELECT 'part-' || p_partkey AS slug, row_number() OVER (ORDER BY md5('11:part-' || p_partkey), 'part-' || p_partkey)::INT AS place FROM part ORDER BY 2 LIMIT 20"""


def daily_terms(spark, sf_dir):
    """The day's five parts; the places are drawn by a published generator from the day's name."""
    return sampling.daily_pick(part_terms(spark, sf_dir), "2026-8-15").select("slug", "pick")


#: The generator's steps in 128-bit integers, kept to 32 bits; then five draws without replacement.
DAILY_TERMS = """WITH RECURSIVE seed AS (
  SELECT list_reduce(list_prepend(0::HUGEINT, list_transform(string_split('2026-8-15', ''), lambda c: ord(c)::HUGEINT)), lambda h, x: (h * 31 + x) % 4294967296) AS s
), a AS (SELECT k, (s + k * 1831565813) % 4294967296 AS s FROM seed, generate_series(1, 5) AS g(k)
), b AS (SELECT k, xor(s, s >> 15) * (s | 1) % 4294967296 AS a FROM a
), c AS (SELECT k, xor(a, (a + xor(a, a >> 7) * (a | 61) % 4294967296) % 4294967296) AS a FROM b
), u AS (SELECT k, xor(a, a >> 14)::DOUBLE / 4294967296 AS u FROM c
), d AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
  SELECT d.k + 1, list_append(gone, list_reduce(list_prepend(floor(u * (n - d.k))::BIGINT, list_sort(gone)), lambda p, g: p + (g <= p)::BIGINT))
  FROM d JOIN u ON u.k = d.k + 1, (SELECT count(*) AS n FROM part)
) SELECT 'part-' || p_partkey AS slug, (i - 1)::INT AS pick FROM (SELECT unnest(gone) AS place, generate_subscripts(gone, 1) AS i FROM d WHERE k = 5) JOIN part ON p_partkey = place"""


def shuffled_questions(spark, sf_dir):
    """All parts in a shuffled order, a place for each."""
    return Z.shuffled(part_terms(spark, sf_dir), "slug", 7).select("slug", F.col("place").cast("long").alias("place"))


SHUFFLED_QUESTIONS = "SELECT 'part-' || p_partkey AS slug, row_number() OVER (ORDER BY md5('7:part-' || p_partkey), '7:part-' || p_partkey) - 1 AS place FROM part"


def grouped_terms(spark, sf_dir):
    """Parts by brand; small ones have none and count as unsorted."""
    t = part_terms(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_ord"), "p_size"), "term_ord")
    g = grouped(t.withColumn("subcategory", F.when(F.col("p_size") > 5, F.col("subcategory")).otherwise("")))
    return g.groupBy("grp").agg(F.count("*").alias("n"), F.min("term_ord").alias("first"))


GROUPED_TERMS = "SELECT CASE WHEN p_size > 5 THEN p_brand ELSE '미분류' END AS grp, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1"


def search_log(spark, sf_dir):
    """Errors as searches that found nothing: those that stood for two hours, each key of a user once."""
    s = _keyed(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("q"), F.col("k").cast("string")).alias("query"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("result_count"), F.col("ts").cast("timestamp").alias("ts"))
    return ST.first_of_session(ST.unanswered_searches(s, "2 hours"), ["session_id", "query"]).select("session_id", "query")


SEARCH_LOG = f"""WITH s AS (SELECT user_id, k, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) - ts AS quiet FROM ({_KEYED}))
SELECT DISTINCT user_id::VARCHAR AS session_id, 'q' || k AS query FROM s WHERE event_type = 'error' AND (quiet IS NULL OR quiet >= INTERVAL 2 HOURS) AND length('q' || k) >= 2"""


def typing_bursts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.typing_bursts(e, "user_id", "3 hours").select("user_id", "value", "n")


TYPING_BURSTS = """WITH s AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 3 HOURS, true)::INT AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
SELECT user_id, arg_max(value, ts) AS value, count(*) AS n FROM g GROUP BY user_id, g"""


def user_bursts(spark, sf_dir):
    """The same over the table that is there as a whole, a user's events spread over days."""
    return L.bursts(table(spark, sf_dir, "events"), "user_id", "3 hours").select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "value", "n")


USER_BURSTS = TYPING_BURSTS.replace("SELECT user_id, arg_max", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, arg_max")

_NAMES = [
    "bookmark_terms", "history_list", "own_rows", "valid_records", "cascaded_tags", "quiz_best_scores", "quiz_retry", "flashcard_counts", "flashcard_decks", "quiz_scope",
    "quiz_questions", "daily_terms", "shuffled_questions", "grouped_terms", "search_log", "typing_bursts", "user_bursts",
]
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {n: globals()[n.upper()] for n in _NAMES}
