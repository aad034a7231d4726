"""Operators over growing logs. Sources are file streams; ``drain`` runs a query over all that has arrived and reads its result.

Where an operator keeps its own state, that is a few numbers a key: rows are folded into buckets or seconds as
they are read, so a key with many rows needs no more memory than the time its rows span.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.functions import text as X
from paperloom.storage import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``, a file or a folder that grows.

    The path is given as a pattern, as a stream takes a plain path for a folder. A backlog is cut into batches of a thousand files.
    """
    return spark.readStream.option("maxFilesPerTrigger", 1_000).schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str = "append", key: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """The stored result of a stream once it has read all its input; a further call with the same ``folder`` goes on from there.

    Every batch overwrites its own part, so a batch that runs again after a failure adds nothing. With ``key``, for
    update mode, only the last version of each key counts.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")  # for logs without rows

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    if not key:
        return rows.drop("batch")
    others = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct("batch", *others)).alias("last")).select(*key, *[F.col("last")[c].alias(c) for c in others])


def first_deliveries(stream: DataFrame, key: str, at: str, delay: str, after: int | None = None) -> DataFrame:
    """ST2: each event once, however often it is delivered within ``delay``; with ``after``, those of a later number only."""
    rows = stream if after is None else stream.filter(F.col(key) > after)
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def clamp_future(at: Column, seen: Column, ahead: str = "5 minutes") -> Column:
    """ST5: a time more than ``ahead`` after the first sighting counts from that sighting. Apply it before the watermark."""
    return F.when(at > seen + F.expr(f"interval {ahead}"), seen).otherwise(at)


def _summed(stream: DataFrame, key: str, at: str, bucket: int, delay: str, n: Column, size: Column) -> DataFrame:
    """(key, bucket, n, size, last): the stream's rows summed by key and bucket of seconds within each Arrow batch, before anything
    moves, so that what reaches a key's state grows with its buckets rather than its rows. last carries the watermark."""
    kind = dict(stream.select(key).dtypes)[key]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby(["k", "bucket"], as_index=False, dropna=False).agg(n=("n", "sum"), size=("size", "sum"), last=("last", "max"))

    rows = stream.filter(F.col(at).isNotNull())
    rows = rows.select(F.col(key).alias("k"), (F.floor(F.unix_timestamp(at) / bucket) * bucket).cast("long").alias("bucket"), n.cast("long").alias("n"), size.cast("long").alias("size"), F.col(at).alias("last"))
    rows = rows.mapInPandas(sums, f"k {kind}, bucket long, n long, size long, last timestamp")
    return rows.withWatermark("last", delay).withColumnRenamed("k", key)


def _ripe(frames: Iterator[pd.DataFrame], state: GroupState, waiting: dict[int, list[int]], bucket: int) -> list[tuple[int, int, int]]:
    """Adds rows of ``_summed`` to ``waiting`` and takes out the buckets that the watermark has passed, in order."""
    for frame in frames:
        for b, n, size in zip(frame["bucket"], frame["n"], frame["size"], strict=True):
            have = waiting.setdefault(int(b), [0, 0])
            have[0] += int(n)
            have[1] += int(size)
    now = state.getCurrentWatermarkMs()
    done = sorted(b for b in waiting if (b + bucket) * 1000 <= now)
    return [(b, *waiting.pop(b)) for b in done]


def growth_alarm(stream: DataFrame, key: str, at: str, size: str, most_files: int, most_bytes: int, delay: str = "10 minutes", bucket: int = 600, span: int = 86_400) -> DataFrame:
    """ST3: (key, bucket, files, bytes, since) of the trailing span after every bucket that has rows.

    since is the first bucket of the alarm that is on, else null; the alarm is on from ``most_files`` files or
    ``most_bytes`` bytes. A bucket is reported once the watermark has passed it, with all its rows, so the way rows are cut
    into batches makes no difference; rows that come later still are left out. The state of a key is the
    sums of one span; it goes once the key has been silent for that long. Null times are left out.
    """
    kind = dict(stream.select(key).dtypes)[key]

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, files, sizes, told, since = state.get if state.exists else ([], [], [], -1, None)
        sums = {a: [f, n] for a, f, n in zip(starts, files, sizes, strict=True)}
        waiting = {a: sums.pop(a) for a in list(sums) if a > told}
        out = []
        for b, f, n in _ripe(() if state.hasTimedOut else frames, state, waiting, bucket):
            if b <= told:
                continue
            sums = {a: v for a, v in sums.items() if a > b - span} | {b: [f, n]}
            f, n = sum(v[0] for v in sums.values()), sum(v[1] for v in sums.values())
            since = (b if since is None else since) if f >= most_files or n >= most_bytes else None
            told = b
            out.append((k[0], b, f, n, since))
        now = state.getCurrentWatermarkMs()
        if not waiting and told >= 0 and now >= (told + bucket + span) * 1000:
            state.remove()
        else:
            kept = sorted(sums | waiting)
            both = sums | waiting
            state.update((kept, [both[a][0] for a in kept], [both[a][1] for a in kept], told, since))
            due = min(waiting) + bucket if waiting else told + bucket + span
            state.setTimeoutTimestamp(max(due * 1000, now + 1))
        yield pd.DataFrame(out, columns=[key, "bucket", "files", "bytes", "since"]).astype({"since": "Int64"})

    rows = _summed(stream, key, at, bucket, delay, F.lit(1), F.coalesce(size, F.lit(0)))
    result = f"{key} {kind}, bucket long, files long, bytes long, since long"
    kept = "starts array<long>, files array<long>, bytes array<long>, told long, since long"
    return rows.groupBy(key).applyInPandasWithState(fold, result, kept, "append", GroupStateTimeout.EventTimeTimeout)


def uncollected_alarm(stream: DataFrame, key: str, at: str, changed: str, age: int = 1_800, alarm: int = 3_600, delay: str = "10 minutes") -> DataFrame:
    """ST6: (key, scan, n, since, active) of every scan of a store: n changes are older than ``age`` seconds, since the scan ``since``.

    A row of the stream is an open path of a scan, ``at`` being the scan's time in whole seconds; a scan of a clean store has one
    row without a change. The alarm is active once such changes have been there for ``alarm`` seconds. A scan is reported once the
    watermark has passed it; the state of a store is its scans until then, two numbers each in arrays, and one number.
    """
    kind = dict(stream.select(key).dtypes)[key]

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, counts, since = state.get if state.exists else (b"", b"", None)
        parts = [(np.frombuffer(starts, np.int64), np.frombuffer(counts, np.int64))]
        for frame in () if state.hasTimedOut else frames:
            parts.append((frame["bucket"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)))
        at, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.zeros(len(at), np.int64)
        np.add.at(n, place, np.concatenate([p[1] for p in parts]))
        done = int(np.searchsorted(at, state.getCurrentWatermarkMs() // 1000 - 1, "right"))
        s, on = at[:done], n[:done] > 0
        # The latest start of a run of such scans, that of the state being the first.
        none = -(2**62)
        first = np.where(on & ~np.r_[since is not None, on][:-1], s, none)
        run = np.maximum.accumulate(np.r_[none if since is None else since, first])[1:]
        if done:
            since = int(run[-1]) if on[-1] else None
        state.update((at[done:].tobytes(), n[done:].tobytes(), since))
        if done < len(at):
            state.setTimeoutTimestamp(max((int(at[done]) + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * done, "scan": s, "n": n[:done], "since": pd.arrays.IntegerArray(run, ~on), "active": on & (s - run >= alarm)})

    old = F.coalesce(F.unix_timestamp(at) - F.unix_timestamp(changed) >= age, F.lit(False))
    rows = _summed(stream, key, at, 1, delay, old.cast("long"), F.lit(0))
    result = f"{key} {kind}, scan long, n long, since long, active boolean"
    return rows.groupBy(key).applyInPandasWithState(fold, result, "starts binary, counts binary, since long", "append", GroupStateTimeout.EventTimeTimeout)


def _rows(times: np.ndarray, events: np.ndarray, pages: np.ndarray, labels: list, most: int) -> Iterator[tuple]:
    """The first ``most`` waiting events as (time, event, path), a few thousand at a time."""
    for low in range(0, most, 8_192):
        part = slice(low, min(low + 8_192, most))
        for at, what, page in zip(times[part].tolist(), events[part].tolist(), pages[part].tolist(), strict=True):
            yield at, labels[what], labels[page]


def enrich_queue(
    stream: DataFrame, key: str, at: str, event: str, path: str, delay: str = "10 minutes", most: int = 1_000, per_tick: int = 2, per_hour: int = 10, retry: int = 1_800, give_up: int = 3
) -> DataFrame:
    """ST7, ST12: (key, at, action, path) of a store's queue of pages to fill in, from its log of events, in whole seconds.

    Events: queued (a page changed), tick (the time to run), done or raced (it leaves the queue; a raced page comes back with
    its next change), failed, and declared or undeclared (an undeclared store holds its pages back). A tick runs ``per_tick``
    pages or fewer, ``per_hour`` an hour, the longest queued first, and none for ``retry`` seconds after a failure. Actions: run,
    dropped (the oldest of more than ``most``) and gave-up (after ``give_up`` failures). A page queued again starts over.

    Events wait until the watermark has passed them and are then taken in order of time, event and path, so the way they are cut into batches makes
    no difference; those that come later still are left out. The state of a store is its queue, bounded by ``most``, the runs of the last hour, and
    the events within ``delay``.
    """
    kind = dict(stream.select(key).dtypes)[key]

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, tries, calls, retry_at, declared, told, labels, *waits = state.get if state.exists else ([], [], [], 0, True, -(2**62), [], b"", b"", b"")
        pending, calls, out = dict(zip(names, tries, strict=True)), list(calls), []
        # What waits: three arrays, events and paths being numbers of labels, each of which is kept once.
        number = {x: n for n, x in enumerate(labels)}
        parts = [tuple(np.frombuffer(x, t) for x, t in zip(waits, (np.int64, np.int32, np.int32), strict=True))]
        for frame in () if state.hasTimedOut else frames:
            frame = frame[frame["_s"] > told]
            coded = lambda c: np.array([number.setdefault(None if pd.isna(x) else x, len(number)) for x in frame[c]], np.int32)  # noqa: B023, E731
            parts.append((frame["_s"].to_numpy(np.int64), coded("_event"), coded("_path")))
        times, events, pages = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        labels = list(number)
        place = {x: n for n, x in enumerate(sorted({x or "" for x in labels}))}
        rank = np.array([place[x or ""] for x in labels], np.int32)
        by = np.lexsort((rank[pages], rank[events], times))
        times, events, pages = times[by], events[by], pages[by]
        now = state.getCurrentWatermarkMs() // 1000
        ripe = int(np.searchsorted(times, now))
        for at, what, page in _rows(times, events, pages, labels, ripe):
            if what == "queued":
                pending.pop(page, None)
                pending[page] = 0
                while len(pending) > most:
                    oldest = next(iter(pending))
                    del pending[oldest]
                    out.append((k[0], at, "dropped", oldest))
            elif what in ("declared", "undeclared"):
                declared = what == "declared"
            elif what in ("done", "raced"):
                pending.pop(page, None)
            elif what == "failed" and page in pending:
                pending[page] += 1
                retry_at = at + retry
                if pending[page] >= give_up:
                    del pending[page]
                    out.append((k[0], at, "gave-up", page))
            elif what == "tick" and declared and at >= retry_at:
                calls = [c for c in calls if at - c < 3_600]
                for name in list(pending)[: max(0, min(per_tick, per_hour - len(calls)))]:
                    calls.append(at)
                    out.append((k[0], at, "run", name))
        told = max(told, int(times[ripe - 1])) if ripe else told
        times = times[ripe:]
        used, codes = np.unique(np.concatenate([events[ripe:], pages[ripe:]]), return_inverse=True)
        codes = codes.astype(np.int32)
        kept = [labels[n] for n in used], times.tobytes(), codes[: len(times)].tobytes(), codes[len(times) :].tobytes()
        state.update((list(pending), list(pending.values()), calls, retry_at, declared, told, *kept))
        if len(times):
            state.setTimeoutTimestamp(max((int(times[0]) + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "at", "action", "path"])

    rows = stream.withWatermark(at, delay).filter(F.col(at).isNotNull()).select(key, at, F.unix_timestamp(at).alias("_s"), F.col(event).alias("_event"), F.col(path).alias("_path"))
    kept = "names array<string>, tries array<int>, calls array<long>, retry_at long, declared boolean, told long, labels array<string>, times binary, events binary, pages binary"
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, at long, action string, path string", kept, "append", GroupStateTimeout.EventTimeTimeout)


def ready_paths(stream: DataFrame, key: str, at: str, forced: str, delay: str = "10 minutes", quiet: int = 120, force: int = 600) -> DataFrame:
    """ST4: (key, since, ready, changes, was_forced), in whole seconds, whenever a path may be saved.

    It may once it has been quiet for ``quiet`` seconds, or ``force`` seconds after its first change if the flag
    ``forced`` is set (text) on its latest change, any of those of that second; it starts anew with the next change. The watermark's clock decides what is still pending.
    """
    kind = dict(stream.select(key).dtypes)[key]

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last, n, text = state.get if state.exists else (None, None, 0, False)
        counts: dict[int, int] = {}
        seen = -(2**62) if last is None else last
        for frame in frames:
            if frame.empty:  # a time-out brings no rows
                continue
            newest = frame["_s"].max()
            if newest >= seen:
                text = bool(frame.loc[frame["_s"] == newest, "_forced"].any()) or (newest == seen and text)
                seen = int(newest)
            for s, m in frame["_s"].value_counts().items():
                counts[int(s)] = counts.get(int(s), 0) + int(m)
        out = []

        def end(now: float) -> bool:
            if text and since + force <= min(now, last + quiet):
                out.append((k[0], since, since + force, n, True))
            elif last + quiet <= now:
                out.append((k[0], since, last + quiet, n, False))
            else:
                return False
            return True

        for s in sorted(counts):
            if since is not None and end(s):
                since, n = None, 0
            since, last, n = s if since is None else since, s if since is None else max(last, s), n + counts[s]
        now = state.getCurrentWatermarkMs() / 1000
        if since is not None and end(now):
            since = None
        if since is None:
            state.remove()
        else:
            state.update((since, last, n, text))
            due = min(last + quiet, since + force if text else last + quiet)
            state.setTimeoutTimestamp(max(due * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "since", "ready", "changes", "was_forced"])

    rows = stream.withWatermark(at, delay).filter(F.col(at).isNotNull()).select(key, at, F.unix_timestamp(at).alias("_s"), F.coalesce(forced, F.lit(False)).alias("_forced"))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, since long, ready long, changes long, was_forced boolean", "since long, last long, n long, text boolean", "append", GroupStateTimeout.EventTimeTimeout)


#: The states that each lifecycle event writes to the ledger.
LIFECYCLE = {
    "dispatched": ["dispatched"],
    "worker-done": ["worker-done", "awaiting-qa"],
    "qa-passed": ["qa-passed", "signal-emitted"],
    "qa-rejected": ["qa-rejected"],
    "failed": ["failed"],
}


def ledger_entries(stream: DataFrame, event: str, at: Column, fields: dict[str, Column]) -> DataFrame:
    """ST8: every row with its ledger lines, one (pos, line) for each state; other events write none."""
    states = F.create_map(*[part for name, found in LIFECYCLE.items() for part in (F.lit(name), F.array(*map(F.lit, found)))])
    rows = stream.select("*", F.posexplode_outer(F.try_element_at(states, F.col(event))).alias("pos", "_state")).filter("_state is not null")
    return rows.withColumn("line", X.ledger_line(at, fields | {"state": F.col("_state")})).drop("_state")


def hourly(stream: DataFrame, key: str, at: str, flagged: Column) -> DataFrame:
    """ST10: (key, hour, samples, flagged) by hour, the hour in seconds; for update mode."""
    rows = stream.groupBy(key, F.window(at, "1 hour").alias("w")).agg(F.count("*").alias("samples"), F.count_if(flagged).alias("flagged"))
    return rows.select(key, F.unix_timestamp(F.col("w.start")).alias("hour"), "samples", "flagged")


def read_inbox(spark: SparkSession, path: str, schema: str, archive: str | None = None) -> DataFrame:
    """ST11: a stream of the JSON files of a folder; with ``archive``, a file is moved there once a later batch has begun, as streams clean up."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(path)


def ingest_once(stream: DataFrame, content: str, order: str, folder: str | None = None) -> DataFrame:
    """ST11: (order, content_sha): of equal contents the first by ``order`` of the batch that brought it; what an earlier batch took is left out.

    The hashes that were taken are keyed state, of which a batch reads and writes what it meets; nothing of earlier results is read. Equal contents are brought
    down to one row within each Arrow batch before anything moves. Null contents count as empty ones.
    """
    kind = dict(stream.select(order).dtypes)[order]

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby("content_sha", as_index=False)[order].min()[[order, "content_sha"]]

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = [frame[order].min() for frame in frames if len(frame)]
        if state.exists or not found:
            yield pd.DataFrame({order: [], "content_sha": []})
        else:
            state.update((True,))
            yield pd.DataFrame({order: [min(found)], "content_sha": [k[0]]})

    rows = stream.select(order, F.sha2(F.coalesce(content, F.lit("")), 256).alias("content_sha")).mapInPandas(least, f"{order} {kind}, content_sha string")
    rows = rows.groupBy("content_sha").applyInPandasWithState(fold, f"{order} {kind}, content_sha string", "taken boolean", "append", GroupStateTimeout.NoTimeout)
    return drain(rows, folder=folder)


def affected_indexes(stream: DataFrame) -> DataFrame:
    """ST1, J21, G5: (store, path) of every index page above the changed (store, path), each once.

    For streams and tables; the state of a stream is the set of folders.
    """
    ancestors = X.ancestors(F.col("path"))
    index = F.transform(ancestors, lambda d: F.when(d == "", "README.md").otherwise(F.concat(d, F.lit("/README.md"))))
    return stream.select("store", F.explode(index).alias("path")).distinct()
