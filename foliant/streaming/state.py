"""Quotas, the job store and uploads as streams with named state (transformWithState): values, lists, maps and timers.

The session needs the RocksDB state store, see STORE.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.books import utc_day
from foliant.sources.files import problem
from foliant.streaming.flows import SHARDS as USER_SHARDS
from foliant.streaming.flows import user_shard

#: What a session's configuration must say for state of this kind.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Shards of the job store, of which each holds as many jobs as the whole store may.
SHARDS = 16


class InOrder(StatefulProcessor):
    """Numbers each user's requests of a day in order of time, whatever the order in which they come; a key is a shard of
    users and a day.

    A list holds the requests that the watermark hasn't passed, as arrays, a value how many each user has; a timer at the
    latest request of a batch hands those over that can't be overtaken any more, another one forgets the day."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "users binary, counts binary")
        self.waiting = handle.getListState("waiting", "users binary, micros binary, events binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest, came = None, []
        for frame in rows:
            users = frame["user_id"] if key[0] >= 0 else np.zeros(len(frame))
            came.append(tuple(np.asarray(x, np.int64) for x in (users, frame["micros"], frame["event_id"])))
            latest = came[-1][1].max() if latest is None else max(latest, came[-1][1].max())
        if came:
            self.waiting.appendValue(tuple(np.concatenate(x).tobytes() for x in zip(*came, strict=True)))
            self.handle.registerTimer(int(latest) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        end = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000)
        if not held:
            if end <= timerValues.getCurrentWatermarkInMs():
                self.seen.clear()
            return
        users, micros, events = (np.frombuffer(b"".join(x), np.int64) for x in zip(*held, strict=True))
        ready = micros <= passed
        if not ready.any():
            return
        if ready.all():
            self.waiting.clear()
        else:
            self.waiting.put([tuple(x[~ready].tobytes() for x in (users, micros, events))])
        order = np.flatnonzero(ready)[np.lexsort((events[ready], micros[ready], users[ready]))]
        each, first, count = np.unique(users[order], return_index=True, return_counts=True)
        seen = pd.Series(dtype=np.int64)
        if self.seen.exists():
            names, counts = (np.frombuffer(x, np.int64) for x in self.seen.get())
            seen = pd.Series(counts, names)
        before = seen.reindex(each, fill_value=0).to_numpy(np.int64)
        nth = np.arange(1, len(order) + 1) + np.repeat(before - first, count)
        seen = seen.add(pd.Series(count, each), fill_value=0).astype(np.int64)
        self.seen.update((seen.index.to_numpy(np.int64).tobytes(), seen.to_numpy().tobytes()))
        self.handle.registerTimer(end)
        yield pd.DataFrame({"event_id": events[order], "user_id": users[order] if key[0] >= 0 else None, "day": key[1], "nth": nth, "allowed": (nth <= self.limit) | (self.limit <= 0)})

    def close(self) -> None:
        pass


def quota_in_order(requests: DataFrame, limit: int, late: str = "1 day", shards: int = USER_SHARDS) -> DataFrame:
    """event_id, user_id, day, nth and allowed of a stream of requests(event_id, user_id, ts), as the batch form numbers
    them, though they may come late by as much as told; those that come later still are dropped by the watermark. A
    request is answered when the watermark has passed it. Days are those of UTC; a limit of none or less allows all."""
    micros = F.unix_micros("ts").alias("micros")
    day = utc_day(F.col("ts")).cast("string").alias("day")
    keyed = requests.withWatermark("ts", late).select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "ts", micros, day, user_shard("user_id", shards).alias("shard"))
    return keyed.groupBy("shard", "day").transformWithStateInPandas(
        statefulProcessor=InOrder(limit), outputStructType="event_id long, user_id long, day string, nth long, allowed boolean", outputMode="Append", timeMode="EventTime"
    )


class Ended(StatefulProcessor):
    """Requests and their ends; a key is a shard of ids, whose rows are held as arrays, so that a batch has a few values of
    state for each shard and not some for each row.

    A request is told with each end that fits as soon as both are there, and without one when the watermark has left
    its time behind. A timer at the first of these times lets go of what can't meet anything any more."""

    STARTS, ENDS = (np.int64, np.int64, np.int64, np.int8), (np.int64, np.int64, np.int32, np.int8)  # id, micros, user or status, marks
    NO_ID, NO_OTHER, TOLD = 1, 2, 4

    def __init__(self, within: int) -> None:
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getValueState("starts", "ids binary, micros binary, users binary, marks binary")
        self.ends = handle.getValueState("ends", "ids binary, micros binary, statuses binary, marks binary")

    def _held(self, state, kinds: tuple) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x, kind in zip(state.get(), kinds, strict=True)] if state.exists() else [np.zeros(0, kind) for kind in kinds]

    def _hold(self, state, arrays: list[np.ndarray]) -> None:
        if len(arrays[0]):
            state.update(tuple(x.tobytes() for x in arrays))
            return
        state.clear()

    def _wait(self, starts: list[np.ndarray], ends: list[np.ndarray]) -> None:
        times = [int(x[1].min()) for x in (starts, ends) if len(x[0])]
        if times:
            self.handle.registerTimer((min(times) + self.within) // 1000 + 1)

    def _met(self, starts: list[np.ndarray], ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of each request and end that have one id and fit in time."""
        known = np.flatnonzero(~ends[3] & self.NO_ID)
        known = known[np.lexsort((ends[1][known], ends[0][known]))]
        ids = ends[0][known]
        low = np.searchsorted(ids, starts[0])
        count = np.where(starts[3] & self.NO_ID, 0, np.searchsorted(ids, starts[0], side="right") - low)
        i = np.repeat(np.arange(len(count)), count)
        j = known[np.arange(len(i)) + np.repeat(low - (np.cumsum(count) - count), count)]
        took = ends[1][j] - starts[1][i]
        fits = (took >= 0) & (took <= self.within)
        return i[fits], j[fits]

    def _rows(self, starts: list[np.ndarray], i: np.ndarray, ends: list[np.ndarray] | None = None, j: np.ndarray | None = None) -> pd.DataFrame:
        ids, micros, users, marks = (x[i] for x in starts)
        none = np.ones(len(i), bool)
        status, ended, no_status = (np.zeros(len(i), np.int32), micros, none) if ends is None else (ends[2][j], ends[1][j], ends[3][j] & self.NO_OTHER > 0)
        array = pd.arrays.IntegerArray
        return pd.DataFrame({
            "event_id": array(ids, marks & self.NO_ID > 0), "user_id": array(users, marks & self.NO_OTHER > 0), "micros": micros,
            "status": array(status, no_status), "took": array(ended - micros, none if ends is None else ~none),
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts, ends = self._held(self.starts, self.STARTS), self._held(self.ends, self.ENDS)
        came = pd.concat(list(rows), ignore_index=True)
        new, is_end = [came[c].to_numpy(np.int64) for c in ("id", "micros", "other", "marks")], came["is_end"].to_numpy(bool)
        new_starts = [x[~is_end].astype(kind) for x, kind in zip(new, self.STARTS, strict=True)]
        new_ends = [x[is_end].astype(kind) for x, kind in zip(new, self.ENDS, strict=True)]
        i, j = self._met(starts, new_ends)
        if len(i):
            yield self._rows(starts, i, new_ends, j)
        starts[3] = starts[3].copy()
        starts[3][i] |= self.TOLD
        ends = [np.concatenate(x) for x in zip(ends, new_ends, strict=True)]
        i, j = self._met(new_starts, ends)
        if len(i):
            yield self._rows(new_starts, i, ends, j)
        new_starts[3][i] |= self.TOLD
        starts = [np.concatenate(x) for x in zip(starts, new_starts, strict=True)]
        self._hold(self.starts, starts)
        self._hold(self.ends, ends)
        self._wait(starts, ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        starts, ends = self._held(self.starts, self.STARTS), self._held(self.ends, self.ENDS)
        before = timerValues.getCurrentWatermarkInMs() * 1000 - self.within
        gone, past = starts[1] < before, ends[1] < before
        if not gone.any() and not past.any():
            return
        alone = np.flatnonzero(gone & (starts[3] & self.TOLD == 0))
        told = self._rows(starts, alone) if len(alone) else None
        starts, ends = [x[~gone] for x in starts], [x[~past] for x in ends]
        self._hold(self.starts, starts)
        self._hold(self.ends, ends)
        self._wait(starts, ends)
        if told is not None:
            yield told

    def close(self) -> None:
        pass


def requests_ended(starts: DataFrame, ends: DataFrame, within: str, late: str, shards: int = USER_SHARDS) -> DataFrame:
    """See flows.request_log. Rows without a time can't be waited for and are left out."""
    time = lambda c: F.unix_micros(c).alias("micros")
    sides = []
    for rows, at, other in ((starts, "ts", "user_id"), (ends, "ended", "status")):
        rows = rows.where(F.col(at).isNotNull()).select(F.col(at).cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col(other).cast("long").alias("other")).withWatermark("at", late)
        marks = F.when(F.col("event_id").isNull(), Ended.NO_ID).otherwise(0) + F.when(F.col("other").isNull(), Ended.NO_OTHER).otherwise(0)
        zero = F.lit(0).cast("long")
        sides.append(rows.select("at", user_shard("event_id", shards).alias("shard"), F.coalesce("event_id", zero).alias("id"), time("at"), F.coalesce("other", zero).alias("other"), marks.alias("marks"), F.lit(at == "ended").alias("is_end")))
    made = sides[0].union(sides[1]).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=Ended(int(pd.Timedelta(within) / pd.Timedelta("1us"))), outputStructType="event_id long, user_id long, micros long, status int, took long", outputMode="Append", timeMode="EventTime"
    )
    return made.select("event_id", "user_id", F.timestamp_micros("micros").alias("ts"), "status", (F.col("took") / 1000).alias("elapsed_ms"))


class JobStore(StatefulProcessor):
    """The newest jobs of a shard, as many as the whole store may hold: a map of what each was set to last.

    A shard's jobs beyond that are older than as many others, so that they can't be among the store's newest. A job
    that is set again is as new as that; a setting older than the one that is held changes nothing."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job_id long", "micros long, event_id long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last: dict[int, tuple] = {}
        for frame in rows:
            for job, *setting in zip(*[frame[c].tolist() for c in ("job_id", "micros", "event_id", "status")], strict=True):
                if job not in last or tuple(setting[:2]) > last[job][:2]:
                    last[job] = tuple(setting)
        held = {k[0]: tuple(v) for k, v in self.jobs.iterator()} if self.jobs.exists() else {}
        told = []
        for job, setting in last.items():
            if job not in held or setting[:2] > held[job][:2]:
                held[job] = setting
                told.append(job)
        gone = sorted(held, key=lambda j: held[j][:2])[: max(0, len(held) - self.capacity)] if self.capacity > 0 else []
        for job in gone:
            if self.jobs.containsKey((job,)):
                self.jobs.removeKey((job,))
        for job in told:
            if job not in gone:
                self.jobs.updateValue((job,), held[job])
        changed = [*((j, held[j], False) for j in told if j not in gone), *((j, held[j], True) for j in gone)]
        if changed:
            yield pd.DataFrame({"job_id": [j for j, _, _ in changed], "event_id": [s[1] for _, s, _ in changed], "status": [s[2] for _, s, _ in changed], "evicted": [e for _, _, e in changed]})

    def close(self) -> None:
        pass


def job_store(settings: DataFrame, capacity: int, shards: int = SHARDS) -> DataFrame:
    """Changes (job_id, event_id, status, evicted) of a store that a stream of settings(job_id, ts, event_id, status)
    fills: what jobs were set to, and which were evicted from their shard. jobs_held tells what it holds. A shard's
    state is as large as the capacity; with a capacity of none or less nothing is evicted."""
    rows = settings.select(F.col("job_id").cast("long").alias("job_id"), F.unix_micros("ts").alias("micros"), F.col("event_id").cast("long").alias("event_id"), "status")
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("job_id"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=JobStore(capacity), outputStructType="job_id long, event_id long, status string, evicted boolean", outputMode="Append", timeMode="None"
    )


def jobs_held(spark: SparkSession, checkpoint: str, capacity: int) -> DataFrame:
    """The jobs (job_id, micros, event_id, status) that a job_store holds, read from its state: the newest of all shards."""
    state = spark.read.format("statestore").option("stateVarName", "jobs").load(checkpoint)
    jobs = state.select(F.col("user_map_key.job_id").alias("job_id"), "user_map_value.*")
    return jobs if capacity <= 0 else jobs.orderBy(F.desc("micros"), F.desc("event_id")).limit(capacity)


class Regrouped(StatefulProcessor):
    """Files of a call's chunks: a file ends with a chunk that says so, or before one of another name.

    Chunks are taken in the order of their numbers, whichever batch they come in; those that come before their turn wait
    in a list, those of the open file are in another one. A timer gives the open file up when the watermark has left
    the call's latest chunk behind by the patience."""

    def __init__(self, patience: int, most_bytes: int) -> None:
        self.patience, self.most_bytes = patience, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, nth long, name string, chunks long, bytes long, latest long")
        self.waiting = handle.getListState("waiting", "seq long, name string, data binary, last boolean")
        self.parts = handle.getListState("parts", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step, nth, name, chunks, size, latest = self.place.get() if self.place.exists() else (0, 0, None, 0, 0, 0)
        found = {x[0]: x[1:] for x in self.waiting.get()} if self.waiting.exists() else {}
        had, parts, files = bool(found), None, []
        for frame in rows:
            latest = max(latest, int(frame["millis"].max()))
            for seq, *chunk in zip(*[frame[c].tolist() for c in ("seq", "name", "data", "last")], strict=True):
                if seq >= step:  # else it came before
                    found.setdefault(seq, tuple(chunk))

        def ended() -> tuple:
            over = 0 < self.most_bytes < size
            return nth, name, None if over else b"".join(parts), chunks, 413 if over else None

        while step in found:
            if parts is None:
                parts = [x[0] for x in self.parts.get()] if chunks and self.parts.exists() else []
            its_name, data, last = found.pop(step)
            if chunks and its_name != name:
                files.append(ended())
                nth, chunks, size, parts = nth + 1, 0, 0, []
            step, name, chunks, size = step + 1, its_name, chunks + 1, size + len(data or b"")
            if not 0 < self.most_bytes < size:
                parts.append(data or b"")
            if last:
                files.append(ended())
                nth, chunks, size, parts = nth + 1, 0, 0, []
        if parts is not None:
            self.parts.put([(x,) for x in parts]) if parts else self.parts.clear()
        if found:
            self.waiting.put([(n, *x) for n, x in found.items()])
        elif had:
            self.waiting.clear()
        self.place.update((step, nth, name, chunks, size, latest))
        self.handle.registerTimer(latest + self.patience)
        if files:
            yield self._rows(key, files)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, nth, name, chunks, _, latest = self.place.get() if self.place.exists() else (0, 0, None, 0, 0, 0)
        if expiredTimerInfo.getExpiryTimeInMs() < latest + self.patience:
            return  # chunks have come since
        late = sorted(self.waiting.get()) if self.waiting.exists() else []
        if chunks or late:
            yield self._rows(key, [(nth, name if chunks else late[0][1], None, chunks + len(late), 408)])
        self.parts.clear()
        self.waiting.clear()
        self.place.clear()

    def _rows(self, key, files: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(files, columns=["nth", "name", "content", "chunks", "status"])
        made["status"] = made["status"].astype("Int32")
        made.insert(0, "call_id", key[0])
        return made

    def close(self) -> None:
        pass


def chunk_files(chunks: DataFrame, patience: str = "1 minute", most_bytes: int = 0) -> DataFrame:
    """Files (call_id, nth, name, content, chunks, problem) of a stream of chunks(call_id long, seq from 0, name, data,
    last, ts). Chunks that come twice count once, those that are later than the patience are dropped. A file that doesn't end within the patience has a problem (408) and no
    content, as has one of over most_bytes (413; none or less: no limit), whose further chunks aren't kept."""
    seconds = pd.Timedelta(patience)
    rows = chunks.withWatermark("ts", patience).select(F.col("call_id").cast("long").alias("call_id"), F.col("seq").cast("long").alias("seq"), "name", "data", F.coalesce("last", F.lit(False)).alias("last"), F.unix_millis("ts").alias("millis"), "ts")
    made = rows.groupBy("call_id").transformWithStateInPandas(
        statefulProcessor=Regrouped(int(seconds.total_seconds() * 1000), most_bytes), outputStructType="call_id long, nth long, name string, content binary, chunks long, status int", outputMode="Append", timeMode="EventTime"
    )
    said = {408: f"no chunk came for {patience}, and none ended the file", 413: f"the file is over the limit of {most_bytes} bytes"}
    told = F.coalesce(*[F.when(F.col("status") == code, problem(code, F.lit(text))) for code, text in said.items()])
    return made.select("call_id", "nth", "name", "content", "chunks", told.alias("problem"))


@contextmanager
def stored(spark: SparkSession) -> Iterator[None]:
    """A session with the state store that streams of this kind need, for as long as they run, and with two partitions of
    state for a core at most: each has a store of its own in every batch, and a stream keeps those that it began with."""
    most = 2 * spark.sparkContext.defaultParallelism
    wanted = STORE | {"spark.sql.shuffle.partitions": str(min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(stream: DataFrame, folder: str) -> str:
    """Runs a stream over what is new and returns the folder of its rows; its checkpoint lies beside it, so that the next
    run goes on where this one ended."""
    with stored(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/rows"
