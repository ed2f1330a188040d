"""Streams: quotas with state, windowed counts of personal data, folders of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions import pii
from foliant.operators.books import utc_day


#: Shards of users that quotas are counted in.
SHARDS = 64


def user_shard(user: str, shards: int) -> Column:
    """The shard of a row's user; rows without one have their own, -1."""
    return F.when(F.col(user).isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(shards))).cast("int")


def quota_stream(requests: DataFrame, limit: int, user: str = "user_id", at: str = "ts", event: str = "event_id", late: str = "1 day", shards: int = SHARDS) -> DataFrame:
    """event, user, day, nth and allowed of a stream of requests; the state holds a count for each user and UTC day, those
    of a shard's users together, so that a batch has a call for each shard and day and not for each user.

    Counts go once the watermark has left the day behind. Within a batch, requests count in the order of
    their time and event; a limit of none or less allows all."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values([at, "no_event", event], ignore_index=True)
        who = rows[user] if key[0] >= 0 else pd.Series(0, rows.index)
        users, counts = state.get if state.exists else ([], [])
        seen = pd.Series(counts, users if key[0] >= 0 else [0] * len(users), dtype="int64")
        nth = who.groupby(who, sort=False).cumcount() + 1 + who.map(seen).fillna(0).astype("int64")
        seen = seen.add(who.value_counts(), fill_value=0).astype("int64")
        state.update((seen.index.tolist() if key[0] >= 0 else [None], seen.tolist()))
        ends = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000)
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        told = rows[event].astype(object).mask(rows["no_event"], None)
        yield pd.DataFrame({event: told, user: who if key[0] >= 0 else None, "day": key[1], "nth": nth, "allowed": (nth <= limit) | (limit <= 0)})

    # without nulls, since pandas would make doubles of whole numbers beside them
    filled = {"no_event": F.col(event).isNull(), event: F.coalesce(event, F.lit(0).cast(kinds[event]))}
    keyed = requests.withWatermark(at, late).withColumns(filled | {"day": utc_day(F.col(at)).cast("string"), "shard": user_shard(user, shards)})
    schema = f"{event} {kinds[event]}, {user} {kinds[user]}, day string, nth long, allowed boolean"
    return keyed.groupBy("shard", "day").applyInPandasWithState(count, schema, f"users array<{kinds[user]}>, seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def pii_stream(texts: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Matches of each type in tumbling windows over a stream (ts, text)."""
    hits = texts.withWatermark(at, late).select(at, F.explode(pii.pii(F.col("text"))).alias("m"))
    counts = hits.groupBy(F.window(at, window).alias("w"), F.col("m.pii_type").alias("pii_type")).agg(F.count(F.lit(1)).alias("matches"))
    return counts.select(F.col("w.start").alias("window_start"), "pii_type", "matches")


def request_log(starts: DataFrame, ends: DataFrame, within: str = "5 minutes", late: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """Requests of a stream (event_id, user_id, ts) with what another stream (event_id, ended, status) says of their ends:
    status and elapsed_ms, both null where no end came within the time. Rows may be late by as much as told; state goes
    when the watermark has passed. The state is that of shards of ids, see state.Ended: a join of the two streams would
    write and remove several values of state for each row."""
    from foliant.streaming import state

    return state.requests_ended(starts, ends, within, late, shards)


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions (user_id, started, ended, requests) of a stream (user_id, ts): requests of a user with less than the gap
    between them; ended is the last request's time and the gap."""
    w = F.session_window("ts", gap).alias("w")
    return requests.withWatermark("ts", late).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("requests")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "requests")


def sliding_counts(requests: DataFrame, kind: str, width: str = "1 day", slide: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Requests (started, kind, requests) of a stream (ts, kind) in windows that overlap."""
    w = F.window("ts", width, slide).alias("w")
    return requests.withWatermark("ts", late).groupBy(w, kind).agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").alias("started"), kind, "requests")


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files below path, as the file source of this library has them."""
    stream = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return stream.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
