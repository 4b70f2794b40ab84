import datetime as dt

from pyspark.sql import Row

from lectern.streaming import paced
from lectern.streaming.paced import Pace, Worker


def play(pace, rows, until):
    """A worker's events, its state carried over as the stream carries it."""
    urls, clock, out = {}, (None, 0), []
    for row in rows:
        w = Worker(pace, dict(urls), *clock)
        w.take(*row)
        urls, clock, out = w.urls, (w.next_tick, w.batch), out + w.out
    w = Worker(pace, dict(urls), *clock)
    w.until(until)
    return out + w.out


def test_two_passes():
    pace = Pace(2, 10, 5, 10)
    rows = [(k, "request", f"u{k}", None) for k in range(7)] + [(11_000, "outcome", "u0", True), (12_000, "outcome", "u1", False), (13_000, "outcome", "u1", True)]
    got = play(pace, rows, 100_000)
    finals = {(u, e, n, b): at for u, e, n, b, at in got if e != "start"}
    assert finals == {("u5", "refused", 0, 0): 5, ("u6", "refused", 0, 0): 6, ("u0", "downloaded", 1, 1): 11_000, ("u1", "failed", 2, 4): 50_000, ("u2", "failed", 2, 4): 50_000, ("u3", "failed", 2, 5): 60_000, ("u4", "failed", 2, 5): 60_000}
    starts = [(u, n, b, at) for u, e, n, b, at in got if e == "start"]
    assert starts == [("u0", 1, 1, 10_000), ("u1", 1, 1, 10_000), ("u2", 1, 2, 20_000), ("u3", 1, 2, 20_000), ("u4", 1, 3, 30_000), ("u1", 2, 4, 40_000), ("u2", 2, 4, 40_000), ("u3", 2, 5, 50_000), ("u4", 2, 5, 50_000)]


def test_what_changes_nothing():
    pace = Pace(5, 10, 5, 10)
    rows = [(0, "outcome", "x", True), (0, "tick", None, None), (1, "request", "u", None), (2, "request", "u", None), (3, "outcome", "u", True), (10_002, "outcome", "u", True), (10_003, "outcome", "u", False), (40_000, "request", "u", None)]
    assert play(pace, rows, 90_000) == [("u", "start", 1, 1, 10_001), ("u", "downloaded", 1, 1, 10_002)]


def test_a_request_after_a_rest_waits_for_the_next_tick():
    pace = Pace(5, 10, 5, 10)
    rows = [(0, "request", "a", None), (10_500, "outcome", "a", True), (500_200, "request", "b", None), (510_500, "outcome", "b", True)]
    assert [(u, at) for u, e, _, _, at in play(pace, rows, 900_000) if e == "start"] == [("a", 10_000), ("b", 510_000)]


def test_stream_stops_and_goes_on(spark, tmp_path):
    schema = "worker long, ts timestamp, kind string, url string, ok boolean"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    before = spark.conf.get(paced.PROVIDER)
    parts = [
        [(w, at(k), "request", f"u{k}", None) for w in (1, 2) for k in range(3)],
        [(1, at(350), "outcome", "u0", True), (1, at(360), "outcome", "u1", False)],
        [(9, at(100_000), "tick", None, None)],
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        with paced.with_timers(spark):
            q = paced.pace(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), Pace(2, 300, 5, 300)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.conf.get(paced.PROVIDER) == before
    got = sorted((r.worker, r.url, r.event, r["pass"]) for r in spark.read.parquet(f"{tmp_path}/out").where("event <> 'start'").collect())
    assert got == [(1, "u0", "downloaded", 1), (1, "u1", "failed", 2), (1, "u2", "failed", 2), (2, "u0", "failed", 2), (2, "u1", "failed", 2), (2, "u2", "failed", 2)]


def test_state_is_read_and_written_once():
    """Whatever the number of addresses; no call for each of them."""
    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def deleteTimer(self, at):
            calls.append("delete")

        def registerTimer(self, at):
            calls.append("register")

    p = paced.Pacing(Pace(2, 10, 50, 10))
    p.worker = p.handle = State()
    row = Row("ms", "kind", "url", "ok")
    assert list(p.handleInputRows((1,), iter([row(k, "request", f"u{k:02}", None) for k in reversed(range(50))]), None)) == []
    assert calls == ["get", "update", "register"] and len(p.worker.value[0]) == 50
    got = list(p.handleInputRows((1,), iter([row(10_500, "outcome", "u00", True), row(10_500, "tick", None, None), row(10_400, None, None, None)]), None))
    assert [(e.worker, e.url, e.event, e.ms) for e in got] == [(1, "u00", "start", 10_000), (1, "u01", "start", 10_000), (1, "u00", "downloaded", 10_500)]
    assert calls[3:] == ["get", "update", "delete", "register"]
