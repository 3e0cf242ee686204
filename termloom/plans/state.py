"""Ledger, quiz and time-driven queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import ledger as L
from termloom.operators import quiz as Z
from termloom.plans.common import part_terms, table
from termloom.sources.shared import fresh_path
from termloom.streaming import state as ST


def latest_state(spark, sf_dir):
    return L.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


LATEST_STATE = """SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1"""


def live_rows(spark, sf_dir):
    """Latest row of each user and key; an error as the last event deletes it."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return L.live(e, ["user_id", "k"], F.col("event_type") == "error").select("user_id", "k", "event_id", "event_type")


LIVE_ROWS = """SELECT user_id, k, event_id, event_type FROM (
  SELECT *, (props::JSON->>'k')::INT AS k, row_number() OVER (PARTITION BY user_id, (props::JSON->>'k')::INT ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 AND event_type <> 'error'"""


def toggle_state(spark, sf_dir):
    return L.toggled(table(spark, sf_dir, "events").filter("event_type = 'click'"), ["user_id"]).select("user_id", "on", "n_toggles")


TOGGLE_STATE = """SELECT user_id, count(*) % 2 = 1 AS "on", count(*) AS n_toggles FROM events WHERE event_type = 'click' GROUP BY 1"""


def mru_queries(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return L.recent(e, "user_id", "k").select("user_id", "k", "place")


MRU_QUERIES = """WITH l AS (SELECT user_id, (props::JSON->>'k')::INT AS k, max(ts) AS t FROM events GROUP BY 1, 2)
SELECT user_id, k, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, k) AS place FROM l) WHERE place <= 5"""


def streaks(spark, sf_dir):
    s = L.streaks(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", ["ts", "event_id"])
    return s.select("event_id", "user_id", F.col("streak").cast("long").alias("streak"))


_STREAK = """s AS (
  SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events
), k AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) END AS streak FROM s
)"""
STREAKS = f"WITH {_STREAK} SELECT event_id, user_id, streak::BIGINT AS streak FROM k"


def quiz_totals(spark, sf_dir):
    """Answers: errors are wrong, values of 90 and more ran out of time."""
    e = table(spark, sf_dir, "events")
    return L.quiz_totals(e, "user_id", F.col("event_type") != "error", ["ts", "event_id"], F.col("value") >= 90)


QUIZ_TOTALS = """WITH a AS (SELECT *, value >= 90 AS late, event_type <> 'error' AND value < 90 AS good FROM events), s AS (
  SELECT *, sum((NOT good)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a
), k AS (
  SELECT *, CASE WHEN good THEN sum(good::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) ELSE 0 END AS streak FROM s
) SELECT user_id, count(*) FILTER (NOT late) AS played, count(*) FILTER (good) AS correct,
  CASE WHEN count(*) FILTER (NOT late) = 0 THEN 0 ELSE floor(100.0 * count(*) FILTER (good) / count(*) FILTER (NOT late) + 0.5) END::BIGINT AS accuracy,
  max(streak)::BIGINT AS best_streak, count(*) FILTER (NOT good) AS missed FROM k GROUP BY user_id"""


def debounce_sessions(spark, sf_dir):
    return L.debounced(table(spark, sf_dir, "events"), "user_id", "6 hours").select("event_id", "user_id")


DEBOUNCE_SESSIONS = """SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
WHERE n IS NULL OR n >= ts + INTERVAL 6 HOURS"""


def lockout(spark, sf_dir):
    """Five errors, with nothing but views between, lock a user for two days; a purchase resets."""
    e = table(spark, sf_dir, "events").filter("event_type in ('error', 'purchase')")
    k = L.lockouts(e, "user_id", F.col("event_type") == "error", most=4, minutes=2880)
    return k.select("user_id", F.date_format("locked_at", "yyyy-MM-dd HH:mm:ss").alias("locked_at"), "n_failures")


LOCKOUT = """WITH RECURSIVE e AS (
  SELECT user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'purchase')
), f(user_id, i, n, until, locked_at, hit) AS (
  SELECT user_id, 0::BIGINT, 0, NULL::TIMESTAMP, NULL::TIMESTAMP, 0 FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i,
    CASE WHEN f.until IS NOT NULL AND e.ts < f.until THEN f.n WHEN NOT e.bad THEN 0 WHEN f.until IS NOT NULL THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.until IS NOT NULL AND e.ts < f.until THEN f.until WHEN e.bad AND (CASE WHEN f.until IS NOT NULL THEN 1 ELSE f.n + 1 END) >= 4 THEN e.ts + INTERVAL 2 DAYS END,
    e.ts,
    CASE WHEN NOT (f.until IS NOT NULL AND e.ts < f.until) AND e.bad AND (CASE WHEN f.until IS NOT NULL THEN 1 ELSE f.n + 1 END) >= 4 THEN 1 ELSE 0 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1
) SELECT user_id, strftime(locked_at, '%Y-%m-%d %H:%M:%S') AS locked_at, n AS n_failures FROM f WHERE hit = 1"""


def tagged_items(spark, sf_dir):
    """Users as bookmarks, event types of large value as tags: those with all of two tags."""
    e = table(spark, sf_dir, "events")
    marks = e.select(F.col("user_id").alias("bookmark_id")).distinct()
    tags = e.filter("value > 60").groupBy(F.col("user_id").alias("bookmark_id"), F.col("event_type").alias("tag")).agg(F.min("ts").alias("created_at"))
    both = L.with_tags(marks, tags)
    return L.tagged(both, ["click", "view"]).select("bookmark_id", F.array_join("tags", ",").alias("tags"))


TAGGED_ITEMS = """WITH t AS (SELECT user_id, event_type AS tag, min(ts) AS c FROM events WHERE value > 60 GROUP BY 1, 2)
SELECT user_id AS bookmark_id, string_agg(tag, ',' ORDER BY c) AS tags FROM t GROUP BY 1 HAVING bool_or(tag = 'click') AND bool_or(tag = 'view')"""


def migrated(spark, sf_dir):
    """Local progress (clicks) merged into remote progress (views), each user and key once."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rows = lambda kind: e.filter(F.col("event_type") == kind).groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"))
    return L.migrate(rows("click"), rows("view"), ["user_id", "k"]).select("user_id", "k", "event_id")


MIGRATED = """WITH r AS (SELECT user_id, (props::JSON->>'k')::INT AS k, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3)
SELECT user_id, k, event_id FROM r WHERE event_type = 'view' UNION ALL
SELECT user_id, k, event_id FROM r WHERE event_type = 'click' AND (user_id, k) NOT IN (SELECT (user_id, k) FROM r WHERE event_type = 'view')"""


def history_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.date_only(F.col("ts")).alias("day"), T.day_seed(F.col("ts")).alias("seed"), T.korean_timestamp(F.col("ts")).alias("shown"))


HISTORY_DATES = """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, year(ts) || '-' || month(ts) || '-' || day(ts) AS seed,
  strftime(ts, '%Y년 ') || month(ts) || '월 ' || day(ts) || '일 ' || CASE WHEN hour(ts) < 12 THEN '오전 ' ELSE '오후 ' END || strftime(ts, '%I:%M') AS shown FROM events"""


def quiz_bands(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("definition", F.col("text"))
    easy = Z.in_band(d, "easy").groupBy("role").agg(F.count("*").alias("n")).withColumn("band", F.lit("easy"))
    hard = Z.in_band(d, "hard").groupBy("role").agg(F.count("*").alias("n")).withColumn("band", F.lit("hard"))
    return easy.unionByName(hard)


QUIZ_BANDS = "SELECT role, count(*) AS n, CASE WHEN length(text) < 120 THEN 'easy' ELSE 'hard' END AS band FROM conversations WHERE text IS NOT NULL GROUP BY 1, 3"


def quiz_distractors(spark, sf_dir):
    """Three wrong names for each part, from the names of all parts, customers and suppliers."""
    parts = part_terms(spark, sf_dir)
    names = parts.select(F.col("title_en").alias("option"))
    for t, c in (("customer", "c_name"), ("supplier", "s_name")):
        names = names.unionByName(table(spark, sf_dir, t).select(F.col(c).alias("option")))
    return Z.distractors(parts.select("slug", F.col("title_en").alias("answer")), names, seed=7)


QUIZ_DISTRACTORS = """WITH o AS MATERIALIZED (
  SELECT option, row_number() OVER (ORDER BY md5(option), option) - 1 AS number, count(*) OVER () AS m
  FROM (SELECT p_name AS option FROM part UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier)
), d AS (
  SELECT 'part-' || p_partkey AS slug, p_name AS answer, i, (SELECT max(m) FROM o) AS m,
         ('0x' || left(md5('7:part-' || p_partkey || ':' || i), 12))::BIGINT AS h
  FROM part, unnest([0, 1, 2, 3]) AS u(i)
), n AS (
  SELECT slug, answer, i, i * m // 4 + h % ((i + 1) * m // 4 - i * m // 4) AS number FROM d WHERE (i + 1) * m // 4 > i * m // 4
), w AS (
  SELECT slug, option, row_number() OVER (PARTITION BY slug ORDER BY i) AS place FROM n JOIN o USING (number) WHERE option <> answer
) SELECT slug, option, place::INT AS place FROM w WHERE place <= 3"""


def event_windows(spark, sf_dir):
    """Events of each type by the hour: the batch form of the streaming counts."""
    from termloom.streaming.state import counts_by_window

    e = counts_by_window(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "1 hour")
    return e.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


EVENT_WINDOWS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"

def lock_seconds(spark, sf_dir):
    """Seconds left of a day's lock from each user's last error at the time of their last event."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("failed"), F.max("ts").alias("now"))
    return e.filter("failed is not null").select("user_id", L.remaining_seconds(F.col("failed") + F.expr("INTERVAL 1 DAY"), F.col("now")).alias("left"))


LOCK_SECONDS = """WITH e AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS failed, max(ts) AS now FROM events GROUP BY 1)
SELECT user_id, greatest(ceil((epoch_us(failed + INTERVAL 1 DAY) - epoch_us(now)) / 1000000.0), 0)::BIGINT AS "left" FROM e WHERE failed IS NOT NULL"""


def annotation_records(spark, sf_dir):
    """Events as annotations: the key as the page, errors without a note."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), k.alias("page"), (F.col("event_id") % 50).alias("start_offset"), (F.col("event_id") % 50 + 5).alias("end_offset"),
        F.col("event_type").alias("quote_text"), F.lit("yellow").alias("color"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("note"), F.col("ts").alias("created_at"))
    return L.annotations(rows).select("id", "documentId", "pageNumber", "startOffset", "endOffset", "quoteText", "note", "position")


ANNOTATION_RECORDS = """SELECT event_id AS id, user_id AS "documentId", row_number() OVER (PARTITION BY user_id ORDER BY (props::JSON->>'k')::INT, event_id % 50, event_id) AS position, (props::JSON->>'k')::INT AS "pageNumber", event_id % 50 AS "startOffset", event_id % 50 + 5 AS "endOffset", event_type AS "quoteText",
  CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS note FROM events"""

def _questions(spark, sf_dir):
    """Views and sign-ups show a question, the others answer one."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("question"), F.col("event_type").isin("view", "signup").alias("shown"), F.col("ts").cast("timestamp").alias("ts"))


#: Events of the whole month in a bucket of the stream.
EVENTS_A_BUCKET = 32_768


def _outcome(rows):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select("user_id", "question", day("shown_at"), "outcome", day("ended_at"))


def question_outcomes(spark, sf_dir):
    """Questions with three hours for each."""
    return _outcome(L.question_outcomes(_questions(spark, sf_dir), 10_800))


QUESTION_OUTCOMES = """WITH e AS (
  SELECT user_id, (props::JSON->>'k')::BIGINT AS question, event_type IN ('view', 'signup') AS shown, ts,
    lead(ts) OVER w AS nxt, lead(event_type IN ('view', 'signup')) OVER w AS again FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), o AS (SELECT *, coalesce(nxt < ts + INTERVAL 3 HOURS, false) AS in_time FROM e WHERE shown)
SELECT user_id, question, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS shown_at, CASE WHEN NOT in_time THEN 'timed_out' WHEN again THEN 'left' ELSE 'answered' END AS outcome,
  strftime(CASE WHEN in_time THEN nxt ELSE ts + INTERVAL 3 HOURS END, '%Y-%m-%d %H:%M:%S.%f') AS ended_at FROM o"""


def question_timer(spark, sf_dir):
    """The same from a stream that gets the month in three parts; a last row of no user moves the watermark past all timers."""
    e = _questions(spark, sf_dir)
    last = e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("question"), F.lit(False).alias("shown"), "ts")
    source, out = fresh_path(spark), fresh_path(spark)
    day = F.dayofmonth("ts")
    slices = [e.filter(day <= 10), e.filter((day > 10) & (day <= 20)), e.filter(day > 20), last]
    slices[0].write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    # More buckets for a longer table, so that what one of them gets at a time does not grow.
    buckets = max(ST.USER_BUCKETS, e.count() // EVENTS_A_BUCKET)
    steps = ST.question_timer(stream, 10_800, buckets=buckets).writeStream.format("parquet").option("checkpointLocation", fresh_path(spark)).option("path", out)
    for more in [None, *slices[1:]]:
        # Files of a part appear one by one: no stream runs meanwhile that would take some of them before the others.
        if more is not None:
            more.write.mode("append").parquet(source)
        q = steps.start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return _outcome(spark.read.parquet(out))


QUESTION_TIMER = QUESTION_OUTCOMES


_NAMES = [
    "latest_state", "live_rows", "toggle_state", "mru_queries", "streaks", "quiz_totals", "question_outcomes", "question_timer", "debounce_sessions", "lockout", "tagged_items", "migrated",
    "history_dates", "quiz_bands", "event_windows", "lock_seconds", "annotation_records", "quiz_distractors",
]
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {n: globals()[n.upper()] for n in _NAMES}
