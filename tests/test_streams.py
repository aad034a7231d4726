"""Streams: paths that are ready against brute force, batches that continue earlier ones, and empty input."""

import json
import random
import tracemalloc
import uuid
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom import plans
from paperloom.storage import shared_root
from paperloom.streaming import logs as L

DATA = "/root/testdata/sf0.001"


def by_hand(times, text, end, quiet=120, force=600):
    """Every save of one path, from its sorted change times, up to the watermark ``end``."""
    out, since, last, n = [], None, None, 0
    for t in [*times, None]:
        if since is not None:
            by_quiet, by_force = last + quiet, since + force if text else float("inf")
            ready = min(by_quiet, by_force)
            if ready <= (end if t is None else t):
                out.append((since, ready, n, by_force <= by_quiet))
                since, n = None, 0
        if t is not None:
            since, last, n = t if since is None else since, t, n + 1
    return out


def test_ready_paths_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", F.unix_timestamp("ts").alias("s"), F.col("ts").cast("timestamp").alias("t")).collect()
    end = int(max(r.t for r in rows).timestamp() - 600)
    want = set()
    for user in {r.user_id for r in rows}:
        for since, ready, n, was in by_hand(sorted(r.s for r in rows if r.user_id == user), user % 2 == 0, end):
            want.add((user, since, ready, n, was))
    got = {tuple(r) for r in plans.QUERIES["stream_ready_paths"](spark, DATA).collect()}
    assert got == want


def test_ready_paths_forces_busy_text_only(spark):
    folder = shared_root(spark) + f"/{uuid.uuid4().hex}"
    rows = [(p, datetime.fromtimestamp(1_000_000 + 60 * k), p == 1) for p in (1, 2) for k in range(25)] + [(3, datetime.fromtimestamp(1_010_000), True)]
    spark.createDataFrame(rows, "p int, t timestamp, text boolean").coalesce(1).write.parquet(f"{folder}/in")
    found = L.drain(L.ready_paths(L.read_log(spark, f"{folder}/in"), "p", "t", F.col("text")))
    got = sorted((r.p, r.since - 1_000_000, r.ready - 1_000_000, r.changes, r.was_forced) for r in found.collect())
    assert got == [(1, 0, 600, 10, True), (1, 600, 1200, 10, True), (1, 1200, 1560, 5, False), (2, 0, 1560, 25, False)]


#: Tests count seconds from here, as a stream takes the start of 1970 for late.
BASE = 864_000


def feed(spark, folder, op, columns):
    """step(rows): appends rows to a log, drains it through ``op`` and gives all that has come out."""

    def step(rows):
        frame = spark.createDataFrame(rows, columns)
        for c in [f.name for f in frame.schema if f.name.startswith("t_")]:
            frame = frame.withColumn(c[2:], F.timestamp_seconds(F.col(c) + BASE)).drop(c)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found = L.drain(op(L.read_log(spark, f"{folder}/in")), folder=f"{folder}/run")
        plain = lambda v: v - BASE if isinstance(v, int) and v >= BASE // 2 else v
        return sorted((tuple(map(plain, r)) for r in found.collect()), key=lambda r: (*r[:2], str(r)))

    return step


def test_growth_alarm_counts_a_bucket_that_is_split_between_batches(spark, tmp_path):
    alarm = lambda s: L.growth_alarm(s.select("k", F.col("at"), "size"), "k", "at", "size", 3, 10**9)
    step = feed(spark, tmp_path, alarm, "k string, t_at long, size long")
    assert step([("a", 0, 1), ("a", 5, None), ("b", 0, 1), ("b", None, 1)]) == []  # the bucket may still grow
    step([("a", 10, 1), ("a", 600, 1), ("b", 2000, 1)])
    got = step([("b", 90_000, 1)])
    assert got == [("a", 0, 3, 2, 0), ("a", 600, 4, 3, 0), ("b", 0, 1, 1, None), ("b", 1800, 2, 2, None)]
    # The onset stays while the alarm is on; what is a whole day old no longer counts.
    got = step([("a", 90_100, 1), ("b", 200_000, 1)])
    assert ("a", 90_000, 1, 1, None) in got and ("b", 90_000, 1, 1, None) in got


def test_uncollected_changes_raise_an_alarm_after_an_hour(spark, tmp_path):
    op = lambda s: L.uncollected_alarm(s, "k", "at", "changed")
    step = feed(spark, tmp_path, op, "k string, t_at long, t_changed long")
    step([("a", 0, -2000), ("a", 0, -10), ("a", 3000, -2000), ("b", 0, None)])
    got = step([("a", 3600, -2000), ("a", 4000, None), ("a", 5000, 0), ("z", 20_000, None)])
    assert got == [("a", 0, 1, 0, False), ("a", 3000, 1, 0, False), ("a", 3600, 1, 0, True), ("a", 4000, 0, None, False), ("a", 5000, 1, 5000, False), ("b", 0, 0, None, False)]


QUEUE = [
    *[("a", k, "queued", f"p{k}") for k in range(4)],
    *[("a", 5, "tick", None), ("a", 6, "done", "p1"), ("a", 7, "failed", "p2"), ("a", 8, "tick", None), ("a", 1807, "tick", None), ("a", 1808, "tick", None)],
    *[("a", 4000, "failed", "p2"), ("a", 4001, "failed", "p2"), ("a", 4002, "undeclared", None), ("a", 7000, "tick", None), ("a", 7001, "declared", None), ("a", 7002, "tick", None), ("a", 7003, "raced", "p3")],
    ("z", 20_000, "tick", None),
]
RUNS = [("a", 3, "dropped", "p0"), ("a", 5, "run", "p1"), ("a", 5, "run", "p2"), ("a", 1807, "run", "p2"), ("a", 4001, "gave-up", "p2"), ("a", 7002, "run", "p3")]


@pytest.mark.parametrize("cuts", [[], [4, 11], [2, 5, 6, 9, 12, 16]])
def test_enrich_queue_however_its_log_is_cut(spark, tmp_path, cuts):
    op = lambda s: L.enrich_queue(s, "k", "at", "event", "page", most=3, per_tick=2, per_hour=3)
    step = feed(spark, tmp_path, op, "k string, t_at long, event string, page string")
    for low, high in zip([0, *cuts], [*cuts, len(QUEUE)], strict=True):
        part = QUEUE[low:high]
        random.Random(low).shuffle(part)
        got = step(part)
    assert got == RUNS  # one run is left of the hour at 1807


def test_inbox_takes_a_content_once_over_all_batches(spark):
    folder = shared_root(spark) + f"/{uuid.uuid4().hex}"

    def step(rows):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return L.ingest_once(L.read_log(spark, f"{folder}/in"), "text", "id", f"{folder}/run")

    step([(1, "a"), (2, "a"), (3, None)])
    assert sorted(r.id for r in step([(4, "a"), (5, "b"), (6, "")]).collect()) == [1, 3, 5]


def test_inbox_files_are_moved(spark, tmp_path):
    inbox, archive = tmp_path / "inbox", tmp_path / "done"
    for folder in (inbox, archive):
        folder.mkdir()
    run = lambda: L.ingest_once(L.read_inbox(spark, str(inbox), "id long, text string", str(archive)), "text", "id", str(tmp_path / "run"))
    for k, text in enumerate(("a", "b", "a")):
        (inbox / f"{k}.json").write_text(json.dumps({"id": k, "text": text}))
        got = sorted(r["id"] for r in run().collect())
    assert got == [0, 1] and len(list(archive.rglob("*.json"))) >= 1 and len(list(inbox.glob("*.json"))) <= 2


def test_clamped_times(spark):
    rows = spark.sql("select timestamp'2024-01-01 10:00:00' as seen, explode(array(timestamp'2024-01-01 10:05:00', timestamp'2024-01-01 10:05:01', null)) as at")
    assert [r.x and r.x.minute for r in rows.select(L.clamp_future(F.col("at"), F.col("seen")).alias("x")).collect()] == [5, 0, None]


def test_empty_log(spark):
    folder = shared_root(spark) + f"/{uuid.uuid4().hex}"
    spark.createDataFrame([], "k string, at timestamp, size long").write.parquet(f"{folder}/in")
    assert L.drain(L.growth_alarm(L.read_log(spark, f"{folder}/in"), "k", "at", "size", 3, 10**9)).count() == 0


class FakeState:
    """A group's state outside a stream, the watermark being at the start."""

    exists = hasTimedOut = False

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, at):
        self.at = at

    def update(self, value):
        self.value = value


def peak_of_fold(monkeypatch, spark, op, frames):
    """Bytes of Python that a fold takes while all rows of ``frames`` wait."""
    found = []
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandasWithState", lambda self, fold, *_: found.append(fold))
    op(spark.createDataFrame([], "k string, at timestamp, changed timestamp, event string, page string"))
    tracemalloc.start()
    list(found[0](("a",), frames, FakeState()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_waiting_scans_are_kept_in_arrays(spark, monkeypatch):
    frames = (pd.DataFrame({"bucket": np.arange(10_000) + low, "n": 1, "size": 0}) for low in range(0, 400_000, 10_000))
    assert peak_of_fold(monkeypatch, spark, lambda s: L.uncollected_alarm(s, "k", "at", "changed"), frames) < 100 * 400_000


def test_waiting_events_are_kept_in_arrays(spark, monkeypatch):
    frames = (pd.DataFrame({"_s": np.arange(10_000) + low, "_event": "queued", "_path": [f"p{n % 50}" for n in range(10_000)]}) for low in range(0, 400_000, 10_000))
    assert peak_of_fold(monkeypatch, spark, lambda s: L.enrich_queue(s, "k", "at", "event", "page"), frames) < 100 * 400_000
