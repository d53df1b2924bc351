"""Stateful behaviour over request logs and files (ST1-ST9, A10).

Each machine is a small fold over one key's events in time order. It runs in batch over sorted
partitions, holding one key's state and one batch of rows at a time however many events a key has,
and in Structured Streaming with the same fold and keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.scalars import BACKOFF, RETRY_AFTER_MOST
from ..store import _path

Fold = Callable[[Any, float, bool], tuple[Any, Any]]
# Errors that open the breaker, the seconds they must lie within, seconds it stays open.
ERRORS, WITHIN, OPEN = 10, 60, 300
ATTEMPTS = 7  # fixed value: one and six retries


def bucket_fold(rate: float) -> Fold:
    """ST2: (state, at, _) -> (state, seconds to wait); capacity and refill are ``rate``; starts full."""

    def step(state, at, _):
        tokens, last = (rate, at) if state is None else state
        tokens = min(rate, tokens + max(0.0, at - last) * rate)
        wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
        # A request that waits takes the token as it is made, so the bucket may owe some.
        return (tokens - 1, max(at, last)), wait

    return step


def breaker_fold(errors: int = ERRORS, within: int = WITHIN, open_s: int = OPEN) -> Fold:
    """ST3: (state, at, is_error) -> (state, is it open after the event).

    The last of ``errors`` errors within ``within`` seconds (both ends included) opens it for
    ``open_s`` seconds, then it starts anew; errors while it is open are not counted.
    """

    def step(state, at, is_error):
        recent, until = ([], None) if state is None else (list(state[0]), state[1])
        if until is not None and at >= until:
            recent, until = [], None
        if until is None and is_error:
            recent = [t for t in recent if at - t <= within] + [at]
            if len(recent) >= errors:
                recent, until = [], at + open_s
        return (recent, until), until is not None

    return step


def fold_sorted(df: DataFrame, key: str, at: str, tie: str, flag: str, fold: Fold, out: str, out_type: str) -> DataFrame:
    """key, tie, at and the fold's value at each event, events in order of (at, tie) within a key."""
    x = df.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), F.col(tie).alias("tie"), F.col(flag).cast("boolean").alias("flag")).where("key is not null and at is not null")
    x = x.repartition("key").sortWithinPartitions("key", "at", "tie")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, state = None, None
        for f in frames:
            values = []
            for k, t, e in zip(f["key"], f["at"], f["flag"]):
                if k != key_now:
                    key_now, state = k, None
                state, v = fold(state, t, bool(e))
                values.append(v)
            yield f[["key", "tie", "at"]].assign(**{out: values})

    kinds = dict(x.dtypes)
    return x.mapInPandas(run, f"key {kinds['key']}, tie {kinds['tie']}, at double, {out} {out_type}")


def fold_stream(stream: DataFrame, key: str, at: str, tie: str, flag: str, fold: Fold, out: str, out_type: str) -> DataFrame:
    """As fold_sorted over a stream; events of one micro-batch are put in order, later batches continue."""
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    x = stream.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), F.col(tie).alias("tie"), F.col(flag).cast("boolean").alias("flag"))
    kinds = dict(x.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else None
        f = pd.concat(list(frames)).sort_values(["at", "tie"])
        values = []
        for t, e in zip(f["at"], f["flag"]):
            state, v = fold(state, t, bool(e))
            values.append(v)
        held.update((pickle.dumps(state),))
        yield pd.DataFrame({"key": k[0], "tie": f["tie"], "at": f["at"], out: values})

    return x.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, tie {kinds['tie']}, at double, {out} {out_type}", "state binary", "append", GroupStateTimeout.NoTimeout)


def rolling_errors(log: DataFrame, seconds: int = 60) -> DataFrame:
    """A10: per error, how many errors its key had in the ``seconds`` before, both ends included.

    Counted per key and second first, so a window holds one row a second.
    """
    e = log.where("event_type = 'error'")
    per = e.groupBy("page_id", "at").agg(F.count("*").alias("n"))
    w = Window.partitionBy("page_id").orderBy("at").rangeBetween(-seconds, 0)
    per = per.withColumn("recent", F.sum("n").over(w)).select("page_id", "at", "recent")
    return e.join(per, ["page_id", "at"]).select("event_id", "page_id", "at", "recent")


def access_history(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """ST4: page_id, day, last_accessed, access_count of an access stream with a timestamp ``ts``.

    Counts per page and day, so that a watermark can close days and append sinks work; the totals
    of a page are sums over its days.
    """
    return stream.withWatermark("ts", late).groupBy("page_id", F.window("ts", "1 day").alias("day")).agg(F.max("ts").alias("last_accessed"), F.count("*").alias("access_count")).select("page_id", F.col("day.start").alias("day"), "last_accessed", "access_count")


def first_responses(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """ST6: the first response of each URL; an immutable cache's content."""
    if not stream.isStreaming:
        return stream.dropDuplicates(["url"])
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])


def keep_latest(target: str, keep: int = 1000) -> Callable[[DataFrame, int], None]:
    """ST5: a foreachBatch sink that keeps the latest requests in a table of two alternating folders, in any file system."""

    def sink(batch: DataFrame, number: int) -> None:
        now, before = f"{target}/v{number % 2}", f"{target}/v{(number + 1) % 2}"
        p, fs = _path(batch.sparkSession, before)
        old = batch.sparkSession.read.schema(batch.schema).parquet(before) if fs.exists(p) else batch.limit(0)
        old.unionByName(batch).orderBy(F.desc("at"), F.desc("event_id")).limit(keep).write.mode("overwrite").parquet(now)

    return sink


def stream_lines(spark: SparkSession, folder: str, delimiter: str = "\n") -> DataFrame:
    """ST1: records of files as they arrive; a record never straddles two chunks."""
    return spark.readStream.option("lineSep", delimiter).text(folder)


def _retryable(status: int) -> bool:
    return status in (0, 408, 425, 429) or status >= 500  # 0: no response at all


class RequestMachine:
    """ST8: one client's requests, in the order kill switch, breaker, cache, then per attempt rate and send.

    A success ends a request and goes into the cache. A status that no retry mends fails it at once
    and says nothing of the endpoint's health. Any other failure counts for the breaker, which is
    asked after it and again after the pause before the next attempt.
    """

    def __init__(self, rate: float, attempts: int):
        self.take, self.judge, self.attempts = bucket_fold(rate), breaker_fold(), attempts
        self.bucket = self.breaker = None
        self.cache: set[str] = set()

    def _open(self, at: float, failed: bool = False) -> bool:
        self.breaker, is_open = self.judge(self.breaker, at, failed)
        return is_open

    def request(self, url: str, at: float, statuses: list[int], retry_after: list | None = None) -> tuple[str, int, float]:
        """(outcome, attempts made, seconds from the request to its end); the last status also stands for later attempts."""
        if self._open(at):
            return "broken", 0, 0.0
        if url in self.cache:
            return "cached", 0, 0.0
        now = at
        for k in range(1, self.attempts + 1):
            self.bucket, wait = self.take(self.bucket, now, False)
            now += wait
            status = statuses[min(k, len(statuses)) - 1]
            if 200 <= status < 300:
                self.cache.add(url)
                return "sent", k, now - at
            if not _retryable(status):
                return "failed", k, now - at
            if self._open(now, True):
                return "broken", k, now - at
            if k == self.attempts:
                return "exhausted", k, now - at
            asked = retry_after[min(k, len(retry_after)) - 1] if retry_after else None
            now += BACKOFF[min(k, len(BACKOFF) - 1)] if asked is None else min(asked, RETRY_AFTER_MOST)
            if self._open(now):
                return "broken", k, now - at
        raise ValueError("a request has at least one attempt")


def request_outcomes(log: DataFrame, rate: float = 10.0, killed: bool = False, attempts: int = ATTEMPTS) -> DataFrame:
    """ST8: event_id, outcome, attempts, wait of each request (client, url, at, event_id, statuses, retry_after).

    ``statuses`` are those that its attempts would get, 0 for no response; ``retry_after``, which may
    be missing, the seconds a response asks to wait. Outcomes are killed, broken, cached, sent,
    failed and exhausted; ``wait`` is the time from the request to its end.
    """
    if killed:
        return log.select("event_id", F.lit("killed").alias("outcome"), F.lit(0).alias("attempts"), F.lit(0.0).alias("wait"))
    after = F.col("retry_after") if "retry_after" in log.columns else F.lit(None)
    x = log.select("client", "url", F.col("at").cast("double").alias("at"), "event_id", F.col("statuses").cast("array<int>").alias("statuses"), after.cast("array<bigint>").alias("retry_after"))
    x = x.where("client is not null and at is not null and size(statuses) > 0").repartition("client").sortWithinPartitions("client", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, machine = None, None
        for f in frames:
            out = []
            for c, url, at, e, statuses, after in zip(f["client"], f["url"], f["at"], f["event_id"], f["statuses"], f["retry_after"]):
                if machine is None or c != client:
                    client, machine = c, RequestMachine(rate, attempts)
                out.append((e, *machine.request(url, at, [int(v) for v in statuses], None if after is None else list(after))))
            yield pd.DataFrame(out, columns=["event_id", "outcome", "attempts", "wait"])

    return x.mapInPandas(run, "event_id bigint, outcome string, attempts int, wait double")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """ST7: the rows unchanged, and how many have passed once an action on them has ended (``.get['rows']``)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class ProgressLog(StreamingQueryListener):
    """ST7: rows read so far by each streaming ingest, told after every batch that passes a multiple of ``every``."""

    def __init__(self, tell: Callable[[str, int], None], every: int = 10_000):
        self.tell, self.every, self.rows = tell, every, {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        before = self.rows.get(run, 0)
        self.rows[run] = before + event.progress.numInputRows
        if self.rows[run] // self.every > before // self.every:
            self.tell(run, self.rows[run])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self.tell(run, self.rows.get(run, 0))


def cancel_jobs(spark: SparkSession, tag: str) -> None:
    """ST7: cooperative cancel of all jobs started under a tag."""
    spark.cancelJobsWithTag(tag) if hasattr(spark, "cancelJobsWithTag") else spark.sparkContext.cancelJobsWithTag(tag)
