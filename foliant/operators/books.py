"""Books of jobs, batches, share links, daily quotas and audits, kept as logs of events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import spans
from foliant.functions.content import hashes
from foliant.functions.pii import pii
from foliant.functions.text import base_metrics
from foliant.operators import ordered


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key. An aggregate, so that a key with very many events is summed up before the shuffle."""
    at = F.struct(*[F.col(c) for c in order])
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("last")).select(key, *[f"last.{c}" for c in rest])


def newest(jobs: DataFrame, capacity: int, *order: str) -> DataFrame:
    """The capacity newest jobs; with none or less, all of them."""
    return jobs if capacity <= 0 else jobs.orderBy(*[F.desc(c) for c in order]).limit(capacity)


def poll(status: Column) -> Column:
    """404 for an unknown job, 202 while it is being processed, else 200."""
    return F.when(status.isNull(), 404).when(status == "processing", 202).otherwise(200)


def utc_day(at: Column) -> Column:
    """The day in UTC of a time, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(at) / 86_400_000_000).cast("int"))


def quota(requests: DataFrame, limit: int, user: str, at: str, tie: str) -> DataFrame:
    """requests with day, nth (of the user's requests on that UTC day) and allowed; a limit of none or less allows all.
    Users with very many requests are split in order."""
    rows = ordered.running_count(requests.withColumn("day", utc_day(F.col(at))), ["day", user], [at, tie], "nth")
    return rows.withColumn("allowed", F.lit(True) if limit <= 0 else F.col("nth") <= limit)


def secret(token: Column, password: Column) -> Column:
    return F.sha2(F.concat_ws(":", token, password), 256)


def share_status(found: Column, now: Column, expires: Column, stored: Column, given: Column, allowed: Column, recipient: Column) -> Column:
    """Of an attempt to open a share: 404 unknown, 410 expired, 401 wrong password, 403 not a recipient, else 200."""
    return (
        F.when(~found, 404)
        .when(expires.isNotNull() & (expires <= now), 410)
        .when(stored.isNotNull() & ~F.coalesce(stored == given, F.lit(False)), 401)
        .when(F.size(F.coalesce(allowed, F.array().cast("array<string>"))) == 0, 200)
        .when(~F.coalesce(F.array_contains(allowed, recipient), F.lit(False)), 403)
        .otherwise(200)
    )


def share_attempts(log: DataFrame, token: str, order: tuple[str, ...], at: str, given: str, recipient: str) -> DataFrame:
    """The opens of a log of shares with code, what share_status says of the share as it was then, and access_count, how
    many of them the share had let in by then, itself included (null unless the code is 200).

    A create (with columns expires, stored and recipients) makes the share anew, so that it counts from none; a delete
    ends it; an open of a share that isn't there is a 404. Tokens with very many rows are split in order."""
    changes = log.where("action IN ('create', 'delete')").select(token, *order, "action", "expires", "stored", "recipients", F.struct(*order).alias("made"))
    opens = log.where("action = 'open'").drop("action", "expires", "stored", "recipients")
    seen = ordered.asof_join(opens, changes, [token], order, ["action", "expires", "stored", "recipients", "made"])
    alive = F.col("found") & (F.col("action") == "create")
    code = share_status(alive, F.col(at), F.col("expires"), F.col("stored"), F.col(given), F.col("recipients"), F.col(recipient))
    told = seen.withColumn("code", code).drop("action", "expires", "stored", "recipients", "found")
    let_in = ordered.running_count(told.where("code = 200"), [token, "made"], order, "access_count")
    return let_in.drop("made").unionByName(told.where("code <> 200").drop("made").withColumn("access_count", F.lit(None).cast("long")))


#: Operations that a batch of files may ask for.
OPERATIONS = ("summarize", "classify", "pii", "hash", "text", "qa", "search")


def batch(files: DataFrame, operation: str, file: str = "file_name") -> DataFrame:
    """A pending row (batch_id, operation, file, status) for each file of a batch. An unknown operation or no file raises."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}, known are: {', '.join(OPERATIONS)}")
    if files.isEmpty():
        raise ValueError("no files")
    return files.select(F.lit(uuid.uuid4().hex[:16]).alias("batch_id"), F.lit(operation).alias("operation"), F.col(file).alias("file"), F.lit("pending").alias("status"))


def run_batch(files: DataFrame, operation: str, content: str = "content", file: str = "file_name", **how) -> DataFrame:
    """What a batch's operation finds, for those that need no model: (file, result as JSON) by pii, hash, text or search."""
    text_ = F.make_valid_utf8(F.col(content).cast("string"))
    found = {
        "hash": lambda: hashes(F.col(content)),
        "pii": lambda: pii(text_),
        "text": lambda: base_metrics(text_),
        "search": lambda: spans.search(text_, **how),
    }.get(operation)
    if found is None:
        raise ValueError(f"{operation!r} needs a model that isn't here")
    return files.select(F.col(file).alias("file"), F.to_json(found()).alias("result"))


def shares_now(log: DataFrame, token: str = "token", *order: str) -> DataFrame:
    """The shares that a log of events (create, open and delete, told by action) leaves: the columns of the last
    create, and access_count, the opens since. One aggregate over the log, with sums before the shuffle."""
    at = F.struct(*[F.col(c) for c in order])
    rest = [c for c in log.columns if c not in (token, "action")]
    is_ = lambda *kinds: F.when(F.col("action").isin(*kinds), at)
    made = log.groupBy(token).agg(F.max_by(F.struct(*rest), is_("create")).alias("last"), F.max(is_("create")).alias("made"), F.max(is_("delete")).alias("gone"))
    alive = made.where("made IS NOT NULL AND (gone IS NULL OR gone < made)")
    opened = log.where("action = 'open'").select(token, at.alias("at")).join(alive.select(token, "made"), token).where("at > made").groupBy(token).agg(F.count(F.lit(1)).alias("access_count"))
    told = alive.join(opened, token, "left").select(token, *[f"last.{c}" for c in rest], F.coalesce("access_count", F.lit(0)).alias("access_count"))
    return told


def shares_of(shares: DataFrame, job: str, job_id: str = "job_id", created: str = "created_at", report: str = "report") -> DataFrame:
    """A job's shares without their reports, the newest first."""
    return shares.where(F.col(job_id) == job).drop(report).orderBy(F.desc(created))


def purge(shares: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """The shares that haven't expired. Times are compared as instants, whatever offset they were written with."""
    return shares.where(F.col(expires).isNull() | (F.col(expires).cast("timestamp") > now.cast("timestamp")))


#: Methods that are audited.
AUDITED = ("POST", "PUT", "PATCH")


def audit(requests: DataFrame) -> DataFrame:
    """A record (method, path, file_name, size, status, elapsed_ms, failure) of each audited request(method, path,
    file_name, size, content_length, status, started, ended, error): a failure is the error, or the status from 400 on."""
    failure = F.coalesce("error", F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
    elapsed = (F.unix_micros("ended") - F.unix_micros("started")) / 1000
    return requests.where(F.col("method").isin(*AUDITED)).select("method", "path", "file_name", F.coalesce("size", "content_length").alias("size"), "status", elapsed.alias("elapsed_ms"), failure.alias("failure"))
