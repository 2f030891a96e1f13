"""Streams with state, the audit log, payloads and history: restarts, late and odd rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import history, payloads
from sparkquarry.store import Shelf
from sparkquarry.streaming import audit, operations

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
BEGIN = dt.datetime(2024, 1, 1)


def some_events(n=400, seed=3, hours=80):
    r = random.Random(seed)
    kinds = ["view", "view", "error", "error", "purchase", "click"]
    return [(k, BEGIN + dt.timedelta(seconds=r.randrange(hours * 3600), microseconds=r.randrange(10**6)), r.randrange(9), r.choice(kinds), 1.0, "{}") for k in range(n)]


def written(spark, path, rows, parts):
    """One file after the other, so that they come in this order."""
    import os
    import shutil

    os.makedirs(path)
    for k in range(parts):
        one = f"{path}-{k}"
        spark.createDataFrame(rows[k::parts] if parts > 1 else rows, EVENTS).coalesce(1).write.parquet(one)
        name = next(f for f in os.listdir(one) if f.endswith(".parquet"))
        shutil.copy(f"{one}/{name}", f"{path}/{k:03d}.parquet")
        os.utime(f"{path}/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return path


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.fixture(scope="module")
def disordered(spark, tmp_path_factory):
    """Each file holds events of all hours, so later files bring what the watermark has passed."""
    rows = sorted(some_events(), key=lambda r: r[1])
    near = [r for k in range(0, len(rows), 8) for r in random.Random(k).sample(rows[k : k + 8], len(rows[k : k + 8]))]
    odd = [(900, None, 1, "view", 1.0, None), (901, BEGIN, None, "view", 1.0, None), (902, BEGIN, 2, None, 1.0, None)]
    return written(spark, str(tmp_path_factory.mktemp("events") / "e"), near + odd, 1), near


def test_lifecycles_of_a_stream_equal_windows(spark, disordered):
    path, _ = disordered
    got = operations.run_available(spark, path)
    want = operations.batch_lifecycles(spark.read.parquet(path))
    assert rows_of(got) == rows_of(want.select(got.columns)) and got.count() == 9
    total = {c: sum(r[c] for r in got.collect()) for c in ("failures", "recoveries", "failed_recoveries", "timeouts", "active")}
    assert all(total[c] > 0 for c in ("failures", "recoveries", "failed_recoveries"))


def test_lifecycles_do_not_hang_on_files_and_restarts(spark, tmp_path):
    """Files in order of time with events out of order inside, read one at a time, the second half after a restart."""
    rows = sorted(some_events(300, 4, 200), key=lambda r: r[1])
    chunks = [random.Random(k).sample(rows[k : k + 60], 60) for k in range(0, 300, 60)]
    folder = tmp_path / "in"
    folder.mkdir()
    root = str(tmp_path / "root")
    for k, chunk in enumerate(chunks):
        one = str(tmp_path / f"w{k}")
        spark.createDataFrame(chunk, EVENTS).coalesce(1).write.parquet(one)
        import glob
        import shutil

        shutil.copy(glob.glob(f"{one}/*.parquet")[0], str(folder / f"{k}.parquet"))
        if k in (2, 4):
            got = operations.run_available(spark, str(folder), 1, root)
    want = operations.batch_lifecycles(spark.read.parquet(str(folder)))
    assert rows_of(got) == rows_of(want.select(got.columns))


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    day = lambda k, h, kind: (k, BEGIN + dt.timedelta(hours=h), 1, kind, 1.0, "{}")
    folder, root = tmp_path / "in", str(tmp_path / "root")
    folder.mkdir()
    import glob
    import shutil

    for k, rows in enumerate([[day(1, 0, "view"), day(2, 50, "click")], [day(3, 1, "error"), day(4, 60, "click"), day(5, 70, "view")]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        shutil.copy(glob.glob(str(tmp_path / f"w{k}/*.parquet"))[0], str(folder / f"{k}.parquet"))
        got = operations.run_available(spark, str(folder), 1, root).collect()
    assert [(r.n, r.failures, r.timeouts, r.state) for r in got] == [(3, 0, 1, "click")]  # the error came 49 hours late, the last view is not passed


# --- audit ------------------------------------------------------------------------------------


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    one, two = (spark.createDataFrame(some_events(120, s), EVENTS) for s in (1, 2))
    log = audit.AuditLog(spark, str(tmp_path / "a"))
    log.append(one, 0)
    log.append(two, 1)
    before = rows_of(log.log()), rows_of(log.links()), rows_of(log.heads(9))
    log.append(two, 1)
    log.append(one, 0)
    assert (rows_of(log.log()), rows_of(log.links()), rows_of(log.heads(9))) == before
    assert log.broken().count() == 0
    seq = [(r.chain, r.seq) for r in log.log().collect()]
    assert len(seq) == 240 == len(set(seq))
    for chain in {c for c, _ in seq}:
        assert sorted(s for c, s in seq if c == chain) == list(range(1, 1 + sum(c == chain for c, _ in seq)))


def test_a_crash_in_the_middle_gives_equal_rows(spark, tmp_path):
    import glob
    import shutil

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        spark.createDataFrame(some_events(80, k), EVENTS).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        shutil.copy(glob.glob(str(tmp_path / f"w{k}/*.parquet"))[0], str(folder / f"{k}.parquet"))
    whole = audit.run_available(spark, str(folder), 1, str(tmp_path / "whole"))
    log, calls = audit.AuditLog(spark, str(tmp_path / "cut")), []

    def failing(batch, k):
        calls.append(k)
        if k == 1 and calls.count(1) == 1:  # the rows are written, the links and heads are not
            from sparkquarry.store import Shelf as S

            audit.entries(batch, log.heads(k), S(spark, "x")).write.mode("overwrite").parquet(f"{log.root}/log/batch={k}")
            raise RuntimeError("executor lost")
        log.append(batch, k)

    with pytest.raises(Exception, match="executor lost"):
        operations.run(operations.stream_of(spark, str(folder), 1), failing, log.root)
    operations.run(operations.stream_of(spark, str(folder), 1), failing, log.root)
    assert calls.count(1) == 2
    assert rows_of(log.log()) == rows_of(whole.log()) and rows_of(log.links()) == rows_of(whole.links())


def test_tampering_breaks_the_chain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 10)
    log = audit.AuditLog(spark, str(tmp_path / "t"))
    log.append(spark.createDataFrame(some_events(100) + [(5, None, None, None, None, None)], EVENTS), 0)
    assert log.broken().count() == 0
    rows = [tuple(r) for r in log.log().collect()]
    at = next(k for k, r in enumerate(rows) if r[0] == "view" and r[1] == 15)
    rows[at] = (*rows[at][:5], "0" * 64)
    spark.createDataFrame(rows, audit.LOG).write.mode("overwrite").parquet(f"{log.root}/log/batch=0")
    assert {r.block for r in log.broken().filter("chain = 'view'").collect()} >= {2} and log.broken().filter("chain <> 'view' or block < 2").count() == 0
    assert "" in {r[0] for r in rows}


# --- payloads and history ---------------------------------------------------------------------


def test_payload_levels_of_odd_properties(spark):
    rows = [(k, BEGIN + dt.timedelta(minutes=k), 1, "a", 1.0, p) for k, p in enumerate(['{"k": 3}', "no json", None, '{"k": "x"}', '{"deep": {"list": [1, {"k": 2}]}}', "[1]", '{"k": 4}'])] + [(50, BEGIN, None, "a", 1.0, "{}"), (51, BEGIN, 2, "é", 1.0, '{"s": "é"}')]
    all_ = payloads.payloads(spark.createDataFrame(rows, EVENTS), Shelf(spark, "t"), page=3, top=2).collect()
    of = lambda user, level: [json.loads(r.payload) for r in sorted(all_, key=lambda r: r.page) if r.user_id == user and r.level == level]
    full = of(1, "full")
    assert [len(p["events"]) for p in full] == [3, 3, 1] and full[1]["events"][1]["props"] == {"deep": {"list": [1, {"k": 2}]}}
    assert "props" not in full[0]["events"][1] and [e["id"] for p in full for e in p["events"]] == list(range(7))
    assert of(1, "truncated")[0]["more"] == 5 and of(1, "summary")[0] == {"user": 1, "n": 7, "types": [{"type": "a", "n": 7, "k": 7}]} and of(1, "dropped") == [{"user": 1, "n": 7}]
    assert {r.user_id for r in all_} == {1, 2} and all(r.bytes == len(r.payload.encode()) for r in all_)
    best = {r.user_id: r.level for r in payloads.fitting(spark.createDataFrame(all_), 60).collect()}
    assert best == {1: "summary" if len(json.dumps(of(1, "summary")[0], separators=(",", ":"))) <= 60 else "dropped", 2: "full" if len(json.dumps(of(2, "full")[0], separators=(",", ":"), ensure_ascii=False).encode()) <= 60 else best[2]}


def test_as_of_joins(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 5, "a"), (3, 10, None), (4, None, "a"), (5, 3, "b")], "id long, t long, k string")
    right = spark.createDataFrame([(5, "a", 1.0), (9, "a", 2.0), (10, "a", 3.0), (11, "a", 4.0), (1, None, 7.0), (None, "a", 9.0)], "t long, k string, v double")
    got = {r.id: r.prior_v for r in history.as_of(left, right, "t", ["k"], ["v"]).collect()}
    assert got == {1: 3.0, 2: 1.0, 3: 7.0, 4: None, 5: None}
    before = {r.id: r.prior_v for r in history.as_of(left, right, "t", ["k"], ["v"], F.lit(-1)).collect()}
    assert before == {1: 2.0, 2: None, 3: 7.0, 4: None, 5: None}


def test_trend_and_changes(spark):
    week = lambda k: BEGIN + dt.timedelta(weeks=k)
    rows = [(week(k), kind, bad) for k, kind, n, f in [(0, "a", 10, 5), (1, "a", 10, 2), (2, "a", 10, 9), (4, "a", 10, 9), (0, "b", 10, 0), (1, "b", 30, 0)] for bad in [True] * f + [False] * (n - f)]
    s = history.weekly(spark.createDataFrame(rows, "ts timestamp, kind string, failed boolean"))
    got = {(r.kind, (r.week - BEGIN).days // 7): (r.delta, r.trend) for r in history.trend(s).collect()}
    assert got == {("a", 0): (None, "new"), ("a", 1): (30.0, "improving"), ("a", 2): (-70.0, "declining"), ("a", 4): (0.0, "stable"), ("b", 0): (None, "new"), ("b", 1): (0.0, "stable")}
    moved = {(r.kind, (r.week - BEGIN).days // 7): r.change for r in history.changes(s).collect()}
    assert moved == {("a", 1): -25.0, ("b", 1): 25.0, ("a", 2): 75.0, ("b", 2): -75.0}
    assert history.changes(s.limit(0)).count() == 0 and history.trend(s.limit(0)).count() == 0


def test_waiting_events_are_few_messages_to_the_state_store():
    """10,000 events of one user: three elements, two questions and two answers; the same summary as event by event."""
    from pyspark.sql import Row

    from sparkquarry.streaming import operations

    class State:
        def __init__(self):
            self.held, self.calls, self.elements = None, 0, 0

        def _call(self, values=()):
            self.calls += 1
            self.elements += len(values)

        def exists(self):
            self._call()
            return self.held is not None

        def get(self):
            self._call()
            return iter(self.held or ()) if self.listed else self.held

        def appendList(self, values):
            self._call(values)
            self.held = (self.held or []) + list(values)

        def put(self, values):
            self._call(values)
            self.held = list(values)

        def update(self, value):
            self._call()
            self.held = value

        def clear(self):
            self._call()
            self.held = None

    class Handle:
        def getListState(self, *_):
            self.waiting = State()
            self.waiting.listed = True
            return self.waiting

        def getValueState(self, *_):
            self.summary = State()
            self.summary.listed = False
            return self.summary

        def registerTimer(self, _):
            pass

    class Timers:
        def __init__(self, mark):
            self.mark = mark

        def getCurrentWatermarkInMs(self):
            return self.mark

    handle, one = Handle(), operations.Lifecycle()
    one.init(handle)
    kinds = ("view", "error", "error", "click")
    rows = [Row(us=k * 1000, event_id=None if k == 7 else k, event_type=kinds[k % 4]) for k in range(10_000)]
    list(one.handleInputRows((1,), iter(rows[::-1]), Timers(0)))
    assert handle.waiting.calls == 1 and handle.waiting.elements == 3
    (out,) = one.handleExpiredTimer((1,), Timers(9_000), None)
    assert (out.state, out.since_us, out.n, out.failures, out.recoveries, out.failed_recoveries, out.longest_us) == ("click", 8_999_000, 9_000, 4_500, 2_250, 2_250, 1_000)
    assert sum(len(part[0]) for part in handle.waiting.held) == 1_000 and handle.waiting.calls <= 3 and handle.summary.calls <= 2
    (out,) = one.handleExpiredTimer((1,), Timers(10_000), None)
    assert out.n == 10_000 and handle.waiting.held is None
