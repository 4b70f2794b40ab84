"""Paced attempts with a second pass, as a stateful stream: batches, pauses, a cap and timeouts kept by timers.

Each worker has its own queue. The clock of a worker begins with its first request and ticks every ``pause`` seconds; a tick
gives up on attempts older than ``patience`` and starts the next ``size`` addresses. What fails, or is not heard of in time, is tried
a second time once nothing of the first pass is queued or running, and then counts as failed. ``cap`` addresses are
taken by a worker, later ones are refused.

Rows in are (``worker``, ``ts``, ``kind``, ``url``, ``ok``) with the kinds ``request``, ``outcome`` and ``tick`` (only the time passes). Rows
out are (``worker``, ``url``, ``event``, ``pass``, ``batch``, ``at``) with the events ``start``, ``downloaded``, ``failed`` and ``refused``.

Rules: a repeated request is no request; an outcome counts for a running attempt, if it is not after the attempt's
deadline; others (late, repeated, unknown) change nothing. Rows of a micro-batch are taken in order of time, and due ticks
come before them; a timer moves workers without rows. State is bounded by ``cap`` addresses for each worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "worker long, url string, event string, pass int, batch int, at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Pace:
    size: int = 15
    pause: int = 300
    cap: int = 100
    patience: int = 300


QUEUED, RUNNING, AGAIN, OVER = 0, 1, 2, 3


class Worker:
    """The queue of one worker: ``urls`` has (seq, state, pass, batch, since) by address; times are in milliseconds."""

    def __init__(self, pace: Pace, urls: dict[str, tuple], next_tick: int | None, batch: int):
        self.pace, self.urls, self.next_tick, self.batch = pace, urls, next_tick, batch
        self.out: list[tuple] = []

    def say(self, url: str, event: str, number: int, batch: int, at: int) -> None:
        self.out.append((url, event, number, batch, at))

    def until(self, now: int) -> None:
        """All ticks that are due."""
        while self.next_tick is not None and self.next_tick <= now:
            if not self.open():
                # nothing to do at the ticks up to now, however many
                self.next_tick += -(-(now + 1 - self.next_tick) // (1000 * self.pace.pause)) * 1000 * self.pace.pause
                return
            self.tick(self.next_tick)
            self.next_tick += 1000 * self.pace.pause

    def open(self) -> bool:
        return any(u[1] != OVER for u in self.urls.values())

    def tick(self, now: int) -> None:
        for url, (_, state, number, batch, since) in sorted(self.urls.items(), key=lambda x: x[1]):
            if state == RUNNING and since + 1000 * self.pace.patience <= now:
                self.end(url, False, since + 1000 * self.pace.patience)
        first = any(u[1] == QUEUED or (u[1] == RUNNING and u[2] == 1) for u in self.urls.values())
        wanted = QUEUED if first else AGAIN
        ready = sorted((u[0], url) for url, u in self.urls.items() if u[1] == wanted)[: self.pace.size]
        if ready:
            self.batch += 1
        for seq, url in ready:
            number = 1 if wanted == QUEUED else 2
            self.urls[url] = (seq, RUNNING, number, self.batch, now)
            self.say(url, "start", number, self.batch, now)

    def end(self, url: str, ok: bool, at: int) -> None:
        seq, _, number, batch, since = self.urls[url]
        again = not ok and number == 1
        self.urls[url] = (seq, AGAIN if again else OVER, number, batch, since)
        if not again:
            self.say(url, "downloaded" if ok else "failed", number, batch, at)

    def take(self, at: int, kind: str, url: str | None, ok: bool | None) -> None:
        if self.next_tick is None and kind == "request":
            self.next_tick = at + 1000 * self.pace.pause
        self.until(at)
        if kind == "request" and url not in self.urls:
            if len(self.urls) < self.pace.cap:
                self.urls[url] = (len(self.urls), QUEUED, 0, 0, at)
            else:
                self.say(url, "refused", 0, 0, at)
        elif kind == "outcome" and url in self.urls:
            _, state, _, _, since = self.urls[url]
            if state == RUNNING and since <= at <= since + 1000 * self.pace.patience:
                self.end(url, bool(ok), at)


Said = Row("worker", "url", "event", "pass", "batch", "ms")
SAID = "worker long, url string, event string, pass int, batch int, ms long"


def in_order(row: Row) -> tuple:
    """By time, kind and address, null last."""
    return row.ms, row.kind is None, row.kind, row.url is None, row.url


STATE = "urls array<struct<url:string,seq:int,state:int,pass:int,batch:int,since:bigint>>, next_tick bigint, batch int"


class Pacing(StatefulProcessor):
    """A ``Worker`` kept in state as one value, so that it is read once and written once however many addresses it has."""

    def __init__(self, pace: Pace):
        self.pace = pace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.worker = handle.getValueState("worker", STATE)

    def load(self) -> Worker:
        urls, next_tick, batch = self.worker.get() or ([], None, 0)
        return Worker(self.pace, {u[0]: tuple(u[1:]) for u in urls}, next_tick, batch)

    def keep(self, worker: Worker, timer: int | None) -> None:
        """``timer`` is the one that is set."""
        if worker.next_tick is not None:
            self.worker.update(([(url, *u) for url, u in worker.urls.items()], worker.next_tick, worker.batch))
        if worker.next_tick is not None and worker.next_tick != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(worker.next_tick)

    def said(self, key, worker: Worker) -> Iterator[Row]:
        return (Said(key[0], *event) for event in worker.out)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        worker = self.load()
        old = worker.next_tick
        for row in sorted(rows, key=in_order):
            worker.take(row.ms, row.kind, row.url, row.ok)
        self.keep(worker, old)
        return self.said(key, worker)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        worker = self.load()
        old = worker.next_tick
        worker.until(timerValues.getCurrentWatermarkInMs())
        self.keep(worker, old)
        return self.said(key, worker)

    def close(self) -> None:
        pass


def pace(rows: DataFrame, settings: Pace | None = None, late: str = "10 minutes") -> DataFrame:
    """The events of a stream of requests and outcomes. ``with_timers`` must be set while the query starts."""
    seen = rows.select("worker", F.col("ts").cast("timestamp").alias("ts"), "kind", "url", "ok").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    # rows rather than frames: workers have few rows each, and a frame costs more than what is done with it
    said = seen.groupBy("worker").transformWithState(statefulProcessor=Pacing(settings or Pace()), outputStructType=SAID, outputMode="Append", timeMode="EventTime")
    return said.withColumn("ms", F.timestamp_millis("ms")).withColumnRenamed("ms", "at")


class with_timers:
    """The state store that timers need, for the queries started within; the session's own is put back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(PROVIDER, self.old) if self.old else self.spark.conf.unset(PROVIDER)
