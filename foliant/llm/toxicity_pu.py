"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; documents of the training fold, whatever their labels, are
the unlabelled text. Linear numpy classifiers over words and word beginnings minimise
pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1)), the risk corrected by the class prior pi.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import column_bytes, fold_of, fresh, replaced, slices, words_of, worker_kept

#: Ids whose texts the classifiers are fitted on, at most, one text of each. Everything else covers all data.
MOST_POSITIVES, MOST_UNLABELLED = 6_000, 18_000
#: Buckets that features are hashed into, features kept, rows a feature must be in, lengths of word
#: beginnings, steps, classifiers, and bytes of text scored at once.
BUCKETS, KEPT, LEAST_ROWS, BEGINNINGS, STEPS, MODELS, BYTES = 1 << 18, 3_000, 4, (4, 5, 6), 150, 5, 2 << 20
#: Bytes of text whose features are found at once for the fit.
FITTED_BYTES = 1 << 20
#: Words whose weights a worker keeps from slice to slice.
TABLE_WORDS = 300_000
EDGES = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings, without ASCII punctuation around it."""
    word = word.strip(EDGES)
    parts = [b"w" + word, *(b"%d" % n + word[:n] for n in BEGINNINGS if len(word) >= n)] if word else []
    return [zlib.crc32(x) % BUCKETS for x in parts]


def word_weights(words: list[bytes], of_bucket: np.ndarray) -> np.ndarray:
    """The sum of the weights of each word's features."""
    found = [word_features(w) for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
    return np.bincount(np.repeat(np.arange(len(words)), sizes), of_bucket[flat], len(words))


def kept_weights(words: list[bytes], of_bucket: np.ndarray, model: str) -> np.ndarray:
    """The same by the worker's table of a model's words, which grows by the new ones."""
    table = worker_kept(model, dict)
    if len(table) > TABLE_WORDS:
        table.clear()
    new = [w for w in words if w not in table]
    table.update(zip(new, word_weights(new, of_bucket).tolist(), strict=True))
    return np.fromiter(map(table.__getitem__, words), np.float64, len(words))


def fit_pu(features: np.ndarray, row: np.ndarray, positive: np.ndarray, width: int, prior: float, seed: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk. features, row: column and row number of each
    entry; positive: whether a row is a positive, else it is unlabelled."""
    n = len(positive)
    draw = np.random.default_rng(seed)
    share = draw.poisson(1.0, n).astype(float)  # each classifier sees its own bootstrap of the rows
    share_p, share_u = np.where(positive, share, 0), np.where(positive, 0, share)
    share_p, share_u = share_p / max(share_p.sum(), 1), share_u / max(share_u.sum(), 1)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = np.bincount(row, w[features], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        cost = np.logaddexp(0, g)  # of saying -1
        slack = share_u @ cost - prior * (share_p @ cost)
        down = (share_u - prior * share_p) * p  # gradient of the risk of saying -1
        # below zero the classifier fits the unlabelled rows too well: step back from that
        by_row = prior * share_p * (p - 1) + down if slack >= 0 else -down
        grad = np.append(np.bincount(features, by_row[row], width), by_row.sum())
        grad[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _rows_of_features(batches):
    """(positive, features of the row's distinct words, place) of rows (text, positive, place)."""
    for batch in fresh(batches):
        for part in slices(batch, 0, FITTED_BYTES):  # a row's numbers become an array before the next row's are made
            found = [np.array(sorted(f for w in set(x.lower().split()) for f in word_features(w)), np.int32) for x in column_bytes(part.column(0))]
            cut = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(found))), part.column(2)], ["positive", "features", "place"])


def first_ids(ids: DataFrame, most: int) -> DataFrame:
    """The distinct ids with the smallest hashes, at most so many. Only rows with small hashes shuffle: some more than
    wanted at first, and more where ids repeat."""
    count, wanted = ids.count(), 4 * most
    while wanted < count:
        small = ids.where(F.xxhash64("doc_id") <= -(1 << 63) + (wanted << 64) // count).distinct()
        if small.count() >= most:
            break
        wanted *= 4
    else:
        small = ids.distinct()
    return small.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of each bucket and bias, learnt from the rows whose fold isn't 0."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = known.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic")).first()
    if not count.toxic:
        return np.zeros(BUCKETS), -5.0
    prior = min(max(count.toxic / count.n, 1e-4), 0.9)
    # ids in the order of a hash: the same rows at any partitioning, as many as the bounds allow
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(MOST_POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    any_ = first_ids(docs.where(F.col("doc_id").isNotNull() & (fold_of() != 0)).select("doc_id"), MOST_UNLABELLED)
    # at most MOST_POSITIVES + MOST_UNLABELLED ids are broadcast, and one text of each is taken
    sample = docs.select("doc_id", "text").join(F.broadcast(some.union(any_.select("doc_id", F.lit(False)))), "doc_id")
    sample = sample.groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("text", "positive", F.xxhash64("doc_id").alias("place"))
    rows = sample.mapInArrow(_rows_of_features, "positive boolean, features array<int>, place long")
    rows = rows.persist()
    try:
        seen = rows.select("positive", F.explode(F.array_distinct("features")).alias("f")).groupBy("f")
        seen = seen.agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u")).where(f"p + u >= {LEAST_ROWS}")
        sizes = {r.positive: r.n for r in rows.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
        n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
        if not n_p or not n_u:
            return np.zeros(BUCKETS), -5.0
        rate = f"((p + u) / {n_p + n_u})"
        z = f"abs(p / {n_p} - u / {n_u}) / sqrt({rate} * greatest(1 - {rate}, 1e-6) * {1 / n_p + 1 / n_u})"
        kept = np.array([r.f for r in seen.selectExpr("f", f"{z} AS z").orderBy(F.desc("z"), "f").limit(KEPT).collect()], np.int64)
        place = np.full(BUCKETS, -1, np.int32)
        place[kept] = np.arange(len(kept))

        def only_kept(batches):
            for batch in batches:
                lists = batch.column(1)
                at = place[lists.flatten().to_numpy(zero_copy_only=False)]
                lengths = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(lengths)), lengths)[at >= 0]
                counts = np.bincount(row, minlength=len(lengths))
                cut = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cut, pa.array(at[at >= 0], pa.int32())), batch.column(2)], ["positive", "features", "place"])

        found = rows.mapInArrow(only_kept, "positive boolean, features array<int>, place long").toArrow()
        found = found.sort_by([("place", "ascending"), ("positive", "ascending")])  # alike at any partitioning
    finally:
        rows.unpersist()
    positive = found.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    lists = found.column("features").combine_chunks()
    features = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(positive)), lists.value_lengths().to_numpy())
    weights, bias = np.zeros(BUCKETS), 0.0
    for seed in range(MODELS):
        w, b = fit_pu(features, row, positive, len(kept), prior, seed)
        weights[kept] += w / MODELS
        bias += b / MODELS
    return weights, bias


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted, a row for each row.

    Only the text is an input of a score: every distinct word of the whole text counts once. A null
    text counts as empty and gets the score of the bias alone. Labels that are null or without an id
    are left out, a document with several labels is toxic if one says so, and rows that repeat each
    get their score. Without a positive label every score is low. An empty table gives an empty result.
    Columns named like the results are replaced."""
    weights, bias = fit(spark, docs, labels)
    shared, model = spark.sparkContext.broadcast((weights.astype(np.float32), bias)), uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        held, b = shared.value
        out = []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, BYTES):
            words, index, counts = words_of(part.column(0))
            text = np.repeat(np.arange(len(counts)), counts)
            once = np.unique(text * max(len(words), 1) + index)
            g = b + np.bincount(once // max(len(words), 1), kept_weights(words, held, model)[once % max(len(words), 1)], len(counts))
            out.append(1 / (1 + np.exp(-np.clip(g, -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    rows = replaced(docs, "held_out", "score", "predicted")
    rows = rows.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return rows.withColumns({"held_out": fold_of() == 0, "predicted": (F.col("score") >= 0.5).cast("int")})

