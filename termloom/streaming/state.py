"""The stateful operators over unbounded event streams (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from termloom.operators.ledger import ANSWERED, LEFT, QUESTION_SECONDS, TIMED_OUT, lockout_step

#: Buckets that users with open questions are dealt to.
USER_BUCKETS = 1024


def event_time(events: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Zone-less times as timestamps, under a watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def typing_bursts(events: DataFrame, key: str, quiet: str = "150 milliseconds", time: str = "ts") -> DataFrame:
    """One row for each burst of a key's events: session windows closed by quiet time."""
    return events.groupBy(F.session_window(time, quiet), key).agg(F.max_by("value", time).alias("value"), F.count("*").alias("n"))


def unanswered_searches(searches: DataFrame, settle: str = "600 milliseconds", least: int = 2) -> DataFrame:
    """Queries of two or more characters that found nothing and stood for the settle time.

    ``searches (session_id, query, result_count, ts)``: a session window gathers what follows
    within the settle time, the last search of it decides.  Each (session, query) once
    follows by ``first_only``.
    """
    last = F.max_by(F.struct("query", "result_count"), "ts").alias("last")
    settled = searches.groupBy(F.session_window("ts", settle), "session_id").agg(last)
    return settled.select("session_id", F.col("session_window.end").alias("ts"), "last.query", "last.result_count").filter((F.col("result_count") == 0) & (F.length("query") >= least))


def first_of_session(rows: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Each key once, at its first time: ``first_only`` over a table that is there as a whole."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), time).alias("r")).select(*keys, "r.*")


def first_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once inside the watermark."""
    return rows.dropDuplicatesWithinWatermark(keys)


def counts_by_window(events: DataFrame, key: str, width: str = "5 minutes", time: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def _with_states(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    """``rows`` through a processor with states and timers, which Spark keeps in RocksDB: a setting of the session."""
    name, usual = "spark.sql.streaming.stateStore.providerClass", "HDFSBackedStateStoreProvider"
    if rows.sparkSession.conf.get(name).endswith(usual):
        rows.sparkSession.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time_mode)


class _Lockouts(StatefulProcessor):
    def __init__(self, most: int, length: int):
        self.most, self.length = most, length

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "n int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, until = self.state.get() if self.state.exists() else (0, None)
        out = []
        every = pd.concat(list(rows)).sort_values("us", kind="stable")
        for us, bad in zip(every["us"], every["bad"], strict=True):
            n, until, locked = lockout_step(n, until, us, bool(bad), self.most, self.length)
            if locked:
                out.append((key[0], us, until, n))
        self.state.update((n, until))
        yield pd.DataFrame(out, columns=["user_id", "l", "e", "n"])

    def close(self) -> None:
        pass


def lockouts(attempts: DataFrame, most: int = 5, minutes: int = 5) -> DataFrame:
    """Streaming twin of ``ledger.lockouts`` over ``(user_id, ts, bad)``.

    A batch's attempts are taken in order of time; ones that come in a later batch than
    their successors are taken as they come.  A user's state is a count and a time.
    """
    kind = attempts.schema["user_id"].dataType.simpleString()
    rows = attempts.select("user_id", F.unix_micros("ts").alias("us"), "bad")
    locks = _with_states(rows, "user_id", _Lockouts(most, minutes * 60_000_000), f"user_id {kind}, l long, e long, n int", "None")
    return locks.select("user_id", F.timestamp_micros("l").alias("locked_at"), F.timestamp_micros("e").alias("unlocks_at"), F.col("n").alias("n_failures"))


class _Questions(StatefulProcessor):
    """One open question a user, kept by buckets of users; a bucket's timer stands at the first end of them and fires without an event."""

    def __init__(self, limit: int, kind: str):
        self.limit, self.kind = limit, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"users array<{self.kind}>, questions array<long>, ats array<long>")

    def _opened(self) -> dict:
        return {user: (question, at) for user, question, at in zip(*(self.open.get() or ((), (), ())), strict=True)}

    def _keep(self, now: dict) -> None:
        if now:
            self.open.update(([*now], [q for q, _ in now.values()], [at for _, at in now.values()]))
        else:
            self.open.clear()

    def _timer(self, at: int) -> int:
        return -(-(at + self.limit) // 1000)  # timers count milliseconds

    def _first(self, now: dict) -> int | None:
        return min((self._timer(at) for _, at in now.values()), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, ended = self._opened(), []
        before = self._first(now)
        every = pd.concat(list(rows)).sort_values(["us", "tie"])
        for user, named, question, asked, shown, us in zip(*(every[c].tolist() for c in ("user", "named", "question", "asked", "shown", "us")), strict=True):
            user = user if named else None
            was = now.pop(user, None)
            if was and us >= was[1] + self.limit:
                ended.append((user, *was, TIMED_OUT, was[1] + self.limit))
            elif was:
                ended.append((user, *was, LEFT if shown else ANSWERED, us))
            if shown:
                now[user] = question if asked else None, us
        first = self._first(now)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if first is not None:
                self.handle.registerTimer(first)
        self._keep(now)
        yield self._rows(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, left, ended = timerValues.getCurrentWatermarkInMs(), {}, []
        for user, (question, at) in self._opened().items():
            if self._timer(at) <= passed:
                ended.append((user, question, at, TIMED_OUT, at + self.limit))
            else:
                left[user] = question, at
        if ended:
            if left:
                self.handle.registerTimer(self._first(left))
            self._keep(left)
        yield self._rows(ended)

    def _rows(self, ended: list[tuple]) -> pd.DataFrame:
        # As objects: beside a null, numbers would become floating ones.
        return pd.DataFrame(ended, columns=["user_id", "question", "s", "outcome", "e"], dtype=object)

    def close(self) -> None:
        pass


def question_timer(events: DataFrame, seconds: int = QUESTION_SECONDS, late: str = "1 minute", buckets: int = USER_BUCKETS) -> DataFrame:
    """Streaming twin of ``ledger.question_outcomes`` over ``(user_id, question long, shown, ts, event_id)``.

    A user has at most one open question.  Users are dealt to ``buckets`` by hash and the open questions of a bucket are one value state, with a
    timer in event time at the first end: when the watermark passes a question's end and no answer has come, it
    times out, though no event of that user follows.  So what a batch costs for states goes with the buckets, not with the users, and a
    task holds one bucket's rows of a batch at a time.  The number of buckets is part of a checkpoint.  Rows later than the watermark are not taken.
    """
    kind = events.schema["user_id"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int").alias("bucket")
    # Numbers without nulls, which pandas would make floating ones; a flag tells which were there.
    whole = lambda c: F.coalesce(c, F.lit(0).cast(kind)) if kind in ("tinyint", "smallint", "int", "bigint") else F.col(c)
    rows = event_time(events, "ts", late).select(
        bucket, whole("user_id").alias("user"), F.col("user_id").isNotNull().alias("named"), F.coalesce(F.col("question").cast("long"), F.lit(0)).alias("question"), F.col("question").isNotNull().alias("asked"),
        F.coalesce("shown", F.lit(False)).alias("shown"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").alias("tie"))
    out = _with_states(rows, "bucket", _Questions(seconds * 1_000_000, kind), f"user_id {kind}, question long, s long, outcome string, e long", "EventTime")
    return out.select("user_id", "question", F.timestamp_micros("s").alias("shown_at"), "outcome", F.timestamp_micros("e").alias("ended_at"))


BUCKETS = 64


def upserts(events: DataFrame, target: str, keys: list[str], checkpoint: str, time: str = "ts", tie: str = "event_id", buckets: int = BUCKETS):
    """Keep the latest row of each key in a table (``upserted`` reads it): every micro-batch is folded in.

    Keys are dealt to buckets by hash and a batch rewrites the buckets that it touches, each
    under a new version; a small table of versions, written last, makes the batch
    visible as a whole.  A batch that is retried finds itself there and does nothing.
    What a batch replaces is removed by the next but one.  A new checkpoint goes on from
    the table as it is.
    """
    from termloom.operators.ledger import latest

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _versions(spark, target)
        mark = f"{checkpoint}#{batch_id}"
        if any(mark == m for _, _, m in seen):
            return
        now_at = {b: v for b, v, _ in seen if b >= 0}
        version = 1 + max([v for _, v, _ in seen], default=0)
        rows = latest(batch, keys, time, tie).withColumn("_b", bucket)
        touched = [r["_b"] for r in rows.select("_b").distinct().collect()]
        old = [f"{target}/rows/v={now_at[b]}/_b={b}" for b in touched if b in now_at]
        if old:
            before = spark.read.schema(batch.schema).parquet(*old)
            rows = latest(before.unionByName(rows.drop("_b")), keys, time, tie).withColumn("_b", bucket)
        rows.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{target}/rows/v={version}")
        state = [(b, version if b in touched else v, "") for b, v in ({**dict.fromkeys(touched, version), **now_at}).items()]
        # The batch itself is a row too: number -1, so that it is known when it is retried.
        state += [(-1, version, mark), *[(b, v, m) for b, v, m in seen if b < 0 and v >= version - 2]]
        spark.createDataFrame(state, "bucket int, version long, mark string").coalesce(1).write.mode("overwrite").parquet(f"{target}/versions/v={version}")
        # What the batch before this one replaced: readers have had a whole batch to move on.
        for b, v, _ in _versions(spark, target, version - 2):
            if b >= 0 and now_at.get(b) != v:
                _remove(spark, f"{target}/rows/v={v}/_b={b}")
        _remove(spark, f"{target}/versions/v={version - 2}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def _path(spark, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _remove(spark, path: str) -> None:
    fs, found = _path(spark, path)
    if fs.exists(found):
        fs.delete(found, True)


def _versions(spark, target: str, version: int | None = None) -> list[tuple[int, int, str]]:
    """``(bucket, version, mark)`` of a table of versions, by default the newest that was written whole.

    A row a bucket and a few marks: its size does not depend on the rows."""
    fs, folder = _path(spark, f"{target}/versions")
    if not fs.exists(folder):
        return []
    done = [s.getPath() for s in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    number = {int(p.getName().split("=")[1]): p.toString() for p in done}
    wanted = max(number, default=None) if version is None else version
    return [tuple(r) for r in spark.read.parquet(number[wanted]).collect()] if wanted in number else []


def upserted(spark, target: str, schema) -> DataFrame:
    """The table as the last whole batch left it."""
    paths = [f"{target}/rows/v={v}/_b={b}" for b, v, _ in _versions(spark, target) if b >= 0]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
