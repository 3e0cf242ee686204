"""User tables as append-only events and the states that they add up to."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.operators.ranking import DAY, placed_in_group, running, slices


def owned(rows: DataFrame, user_id, user: str = "user_id") -> DataFrame:
    """Only the user's own rows.  Operators here take whole tables and keep users apart by key;
    a read on behalf of one user goes through this filter, which reaches the scan."""
    return rows.filter(F.col(user) == F.lit(user_id))


def newest_first(rows: DataFrame, user: str, time: str, tie: str) -> DataFrame:
    """Each user's rows with ``place`` 1.. from the newest; days are the cells, so that a user with
    a large share of the rows is spread over tasks."""
    day = -F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date"))
    return placed_in_group(rows, [user], [day], [F.desc(time), F.desc(tie)])


def latest(events: DataFrame, keys: list[str], time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last row of each key: what upserts leave.  One aggregate, no sort."""
    rest = [c for c in events.columns if c not in keys]
    top = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r"))
    return top.select(*keys, "r.*")


def live(events: DataFrame, keys: list[str], deleted: Column, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest rows without those whose last event deletes them."""
    return latest(events, keys, time, tie).filter(~deleted)


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """``on`` after each key's toggles: an odd number of them."""
    return events.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("on"), F.count("*").alias("n_toggles"))


def recent(events: DataFrame, user: str, item: str, keep: int = 5, time: str = "ts") -> DataFrame:
    """Most recently used: each item once, at its last use, the newest ``keep`` of a user."""
    last = events.groupBy(user, item).agg(F.max(time).alias("last_used"))
    place = F.row_number().over(W.partitionBy(user).orderBy(F.desc("last_used"), item))
    return last.withColumn("place", place).filter(F.col("place") <= keep)


def with_terms(bookmarks: DataFrame, terms: DataFrame, category: str | None = None) -> DataFrame:
    """Bookmarks ``(slug, ..)`` with their terms' ``title_en`` and ``categories``, null where there is no such term.

    A category keeps the bookmarks of its terms; one without a term is in none.
    """
    out = bookmarks.join(terms.select("slug", "title_en", "categories"), "slug", "left")
    return out.filter(F.array_contains("categories", category)) if category else out


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of parents that still live."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def migrate(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Remote rows and the local ones that they lack."""
    return remote.unionByName(local.join(remote.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def with_tags(bookmarks: DataFrame, tags: DataFrame) -> DataFrame:
    """Bookmarks with their tags in order of creation."""
    own = tags.groupBy("bookmark_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "tag"))), lambda t: t["tag"]).alias("tags"))
    return bookmarks.join(own, "bookmark_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tagged(bookmarks: DataFrame, active: list[str]) -> DataFrame:
    """Bookmarks that have all active tags."""
    return bookmarks.filter(F.size(F.array_except(F.array(*map(F.lit, active)).cast("array<string>"), F.col("tags"))) == 0)


def valid_tag(tag: Column) -> Column:
    return (F.length(F.trim(tag)) > 0) & (F.length(tag) <= 30)


# The judgements of a flash card.
KNOWN, UNKNOWN = "known", "unknown"


def valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(KNOWN, UNKNOWN), F.lit(False))


def judged(judgements: DataFrame, session: list[str], card: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last judgement of each card in a session."""
    return latest(judgements, [*session, card], time, tie)


def judgement_counts(last: DataFrame, session: list[str]) -> DataFrame:
    """Cards known and not known in each session."""
    return last.groupBy(*session).agg(F.count_if(F.col("status") == KNOWN).alias("n_known"), F.count_if(F.col("status") == UNKNOWN).alias("n_unknown"))


def study_deck(cards: DataFrame, last: DataFrame, session: list[str], deck: str, card: str) -> DataFrame:
    """What a session shows under "unknown only": those cards of its deck, or the whole deck where it has none.

    ``cards (deck, card)``; ``last``: one row for each session and card, with ``deck`` and ``status``.
    """
    sessions = last.groupBy(*session, deck).agg(F.count_if(F.col("status") == UNKNOWN).alias("_unknown"))
    unknown = last.filter(F.col("status") == UNKNOWN).select(*session, deck, card).join(cards.select(deck, card).distinct(), [deck, card], "left_semi")
    shown = unknown.groupBy(*session, deck).agg(F.count("*").alias("_shown"))
    whole = sessions.join(shown, [*session, deck], "left_anti").select(*session, deck).join(cards.select(deck, card).distinct(), deck)
    return unknown.select(*session, deck, card).unionByName(whole.select(*session, deck, card))


def streaks(answers: DataFrame, user: str, good: Column, order: list[str]) -> DataFrame:
    """Each answer's running streak: good ones in a row, 0 at a bad one.

    The good answers so far, less those up to the last bad one; both run over days (``running``), so that one user's
    answers are spread over tasks."""
    cell = slices(answers, order[0])
    rows = running(answers.withColumn("_good", good), [user], cell, order, {"_so_far": ("sum", F.col("_good").cast("long"))})
    rows = running(rows, [user], cell, order, {"_at_bad": ("max", F.when(~F.col("_good"), F.col("_so_far")))})
    return rows.withColumn("streak", F.when(F.col("_good"), F.col("_so_far") - F.coalesce("_at_bad", F.lit(0))).otherwise(0)).drop("_good", "_so_far", "_at_bad")


def quiz_totals(answers: DataFrame, user: str, good: Column, order: list[str], timed_out: Column | None = None) -> DataFrame:
    """Played, right, rounded accuracy (0 for none played), best streak and missed questions of each user.

    A question that ran out of time ends the streak and counts as missed, but not as played.
    """
    late = F.lit(False) if timed_out is None else timed_out
    s = streaks(answers.withColumn("_late", late), user, good & ~late, order)
    n, right = F.count_if(~F.col("_late")), F.count_if(good & ~F.col("_late"))
    accuracy = F.when(n == 0, 0).otherwise(F.floor(100 * right / F.greatest(n, F.lit(1)) + 0.5)).cast("long")
    return s.groupBy(user).agg(
        n.alias("played"), right.alias("correct"), accuracy.alias("accuracy"), F.max("streak").alias("best_streak"), (F.count("*") - right).alias("missed")
    )


def quiz_scores(answers: DataFrame, user: str, session: str, good: Column) -> DataFrame:
    """Best score of each user over sessions; a session's score is its right answers."""
    per = answers.groupBy(user, session).agg(F.count_if(good).alias("score"))
    return per.groupBy(user).agg(F.max("score").alias("best_score"), F.count("*").alias("n_sessions"))


def retry_questions(answers: DataFrame, user: str, item: str, good: Column, time: str, tie: str) -> DataFrame:
    """``(user, item, first_missed)``: what a retry asks, each missed item once at its first miss."""
    missed = answers.filter(~good)
    return missed.groupBy(user, item).agg(F.min(F.struct(time, tie)).alias("m")).select(user, item, F.col(f"m.{tie}").alias("first_missed"))


def debounced(events: DataFrame, key: str, quiet: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events after which their key stays quiet for the interval: the last keystroke of each burst.

    The next event is the earliest later one, found within the day or carried back from the next day that has any."""
    rows = running(events, [key], slices(events, time), [time, tie], {"_next": ("min", F.col(time))}, later=True, own=False)
    return rows.filter(F.col("_next").isNull() | (F.col("_next") >= F.col(time) + F.expr(f"INTERVAL {quiet}"))).drop("_next")


def bursts(events: DataFrame, key: str, quiet: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """``(key, started, value, n)``: one row for each burst of a key's events, closed by quiet time; ``value`` is that of its last event.

    The streaming form is ``state.typing_bursts``, session windows.  Here a burst is named after its first event, the latest one
    that opened one (``running``), so a key's events are spread over days and only one burst's are added up together."""
    cell, order = slices(events, time), [time, tie]
    rows = running(events, [key], cell, order, {"_before": ("max", F.col(time))}, own=False)
    opens = F.col("_before").isNull() | (F.col(time) >= F.col("_before") + F.expr(f"INTERVAL {quiet}"))
    rows = running(rows, [key], cell, order, {"started": ("max", F.when(opens, F.col(time)))})
    return rows.groupBy(key, "started").agg(F.max_by("value", F.struct(time, tie)).alias("value"), F.count("*").alias("n"))


#: Seconds for a question of the quiz.
QUESTION_SECONDS = 15
# What becomes of a question.
ANSWERED, TIMED_OUT, LEFT = "answered", "timed_out", "left"


def question_outcomes(events: DataFrame, seconds: int = QUESTION_SECONDS, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """``(user_id, question, shown_at, outcome, ended_at)`` for every question shown.

    ``events (user_id, question, shown boolean, ts, event_id)``: a question is shown, or the open one answered.  It is
    ``answered`` if an answer is the user's next event and comes before the time is up, ``left`` if another question is shown before that,
    and otherwise ``timed_out`` when the time is up, though no event says so.  An answer without an open question
    is no outcome.  The streaming twin is ``state.question_timer``."""
    following = F.struct(F.col(time).cast("timestamp").alias("at"), F.col(tie).alias("tie"), F.col("shown").alias("again"))
    rows = running(events, ["user_id"], slices(events, time), [time, tie], {"_next": ("min", following)}, later=True, own=False)
    shown_at, limit = F.col(time).cast("timestamp"), F.make_dt_interval(secs=F.lit(seconds))
    in_time = F.coalesce(F.col("_next.at") < shown_at + limit, F.lit(False))
    outcome = F.when(~in_time, TIMED_OUT).when(F.col("_next.again"), LEFT).otherwise(ANSWERED)
    return rows.filter("shown").select("user_id", "question", shown_at.alias("shown_at"), outcome.alias("outcome"), F.when(in_time, F.col("_next.at")).otherwise(shown_at + limit).alias("ended_at"))


def lockout_step(n: int, until: int | None, ts: int, bad: bool, most: int, length: int) -> tuple[int, int | None, bool]:
    """State after one attempt, and whether it locked the account.  Times in microseconds."""
    if until is not None:
        if ts < until:
            return n, until, False
        n, until = 0, None
    if not bad:
        return 0, None, False
    n += 1
    return (n, ts + length, True) if n >= most else (n, None, False)


def lockouts(attempts: DataFrame, user: str, failed: Column, most: int = 5, minutes: int = 5, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """``(user, locked_at, unlocks_at, n_failures)``: when ``most`` failures in a row lock an account.

    Failures have no time window; a success forgets them.  While locked, attempts do
    nothing; the first one after the lock has run out starts afresh.

    After a success that no failure precedes by less than a lock's length, the account is neither locked nor counting,
    whatever came before.  Such successes cut a user's attempts into stretches that are folded apart, so one user keeps many tasks
    busy; a task streams its stretches in order of time and holds one count and one lock.  Only failures that never cease for
    ``minutes`` are one stretch.  The user's own type is kept.
    """
    length = minutes * 60_000_000
    rows = attempts.select(F.col(user).alias("u"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.coalesce(failed, F.lit(False)).alias("bad"), F.col(tie).alias("tie"))
    kind = rows.schema["u"].dataType.simpleString()
    cell = F.floor(F.col("t") / DAY)
    rows = running(rows, ["u"], cell, ["t", "tie"], {"_failed": ("max", F.when(F.col("bad"), F.col("t")))}, own=False)
    clear = ~F.col("bad") & (F.col("_failed").isNull() | (F.col("t") - F.col("_failed") >= length))
    rows = running(rows, ["u"], cell, ["t", "tie"], {"stretch": ("max", F.when(clear, F.col("t")))})

    def fold(batches):
        last, n, until = None, 0, None
        for b in batches:
            at, bounds, counts = [], [], []
            for i, (u, s, t, bad) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)):
                if (u, s) != last:
                    last, n, until = (u, s), 0, None
                n, until, locked = lockout_step(n, until, t, bad, most, length)
                if locked:
                    at.append(i)
                    bounds.append(until)
                    counts.append(n)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(2).take(where), pa.array(bounds, pa.int64()), pa.array(counts, pa.int32())], ["u", "l", "e", "n"])

    rows = rows.repartition("u", "stretch").sortWithinPartitions("u", "stretch", "t", "tie").select("u", "stretch", "t", "bad")
    out = rows.mapInArrow(fold, f"u {kind}, l long, e long, n int")
    return out.select(F.col("u").alias(user), F.timestamp_micros("l").alias("locked_at"), F.timestamp_micros("e").alias("unlocks_at"), F.col("n").alias("n_failures"))


def annotations(rows: DataFrame) -> DataFrame:
    """Stored annotations under the names that readers use, without null notes, and ``position``:
    their place in the document by page, then start, then id."""
    placed = placed_in_group(rows, ["document_id"], [F.col("page")], ["start_offset", "id"], "position")
    return placed.select(
        "id", F.col("document_id").alias("documentId"), F.col("page").alias("pageNumber"), F.col("start_offset").alias("startOffset"), F.col("end_offset").alias("endOffset"),
        F.col("quote_text").alias("quoteText"), "color", F.coalesce("note", F.lit("")).alias("note"), F.col("created_at").alias("createdAt"), "position",
    )


def remaining_seconds(until: Column, now: Column) -> Column:
    """Whole seconds, rounded up, until a lock ends; 0 after it."""
    left = until.cast("timestamp").cast("double") - now.cast("timestamp").cast("double")
    return F.greatest(F.ceil(left), F.lit(0)).cast("long")
