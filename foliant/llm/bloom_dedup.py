"""Exact dedup by two passes of Bloom filtering.

Pass one sets bits for every text hash and keeps the bits that two rows may share; pass two tests
each row against that plane. Rows that fail the test are surely single and pass straight through;
only the rest shuffle, by hash, with sums before the shuffle. Beyond the rows of one plane the
hashes are cut into ranges, each with a plane of its own, so that a row has as many bits at any size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.llm.common import Scratch, free_names, mix64, replaced

#: Bits of a plane for each row, number of probes, and the bits of a plane (64 MB), which is broadcast.
BITS_PER_ROW, PROBES, MOST_BITS = 16, 4, 1 << 29
SEGMENT_BITS = 1 << 19


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers of each key, a row for each key; bits is a power of two."""
    keys = keys.astype(np.int64).view(np.uint64)
    step = mix64(keys ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        at = mix64(keys)[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)
    return (at & np.uint64(bits - 1)).astype(np.int64)


def _positions(bits: int):
    def run(batches):
        for batch in batches:
            keys, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            if not len(keys):
                continue
            at = np.unique(probes(keys, bits).ravel())
            again = np.unique(probes(keys[counts > 1], bits).ravel())  # two rows of this batch
            every = np.concatenate([at, again])
            segment = every // SEGMENT_BITS
            order = np.argsort(segment, kind="stable")
            every, segment = every[order], segment[order]
            cuts = np.flatnonzero(np.diff(segment)) + 1
            parts = np.split((every % SEGMENT_BITS).astype(np.uint32), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(segment[np.r_[0, cuts]].astype(np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["segment", "bits"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    hits = np.zeros(SEGMENT_BITS, np.uint8)
    for blob in table.column("bits").to_pylist():
        at, n = np.unique(np.frombuffer(blob, np.uint32), return_counts=True)
        hits[at] = np.minimum(hits[at] + np.minimum(n, 2).astype(np.uint8), 2)
    plane = np.packbits(hits >= 2, bitorder="little")
    return pa.table({"segment": table.column("segment").slice(0, 1), "plane": pa.array([plane.tobytes()], pa.binary())})


def repeated_plane(keyed: DataFrame, bits: int) -> np.ndarray:
    """The plane of the bits that at least two rows of keyed(key) may share.

    A task sends the positions it sets, not a plane, so that what is sent follows the rows."""
    segments = max(1, bits // SEGMENT_BITS)
    sent = keyed.select("key").mapInArrow(_positions(bits), "segment int, bits binary")
    merged = sent.repartition(-(-segments // 4), "segment").groupBy("segment").applyInArrow(_merge, "segment int, plane binary").collect()
    plane = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
    for row in merged:
        plane[row.segment * SEGMENT_BITS // 8 :][: SEGMENT_BITS // 8] = np.frombuffer(row.plane, np.uint8)
    return plane


def planes_for(rows: int) -> tuple[int, int]:
    """Number of ranges of hashes, and bits of the plane of each: a power of two, MOST_BITS at most."""
    ranges = max(1, -(-BITS_PER_ROW * rows // MOST_BITS))
    return ranges, 1 << max(16, (BITS_PER_ROW * max(-(-rows // ranges), 1) - 1).bit_length())


def _tested(spark: SparkSession, scratch: Scratch, rows: DataFrame, bits: int, name: str, key: str, maybe: str) -> DataFrame:
    """rows with maybe, whether another row may have the same key; written, so that the plane can go."""
    shared = spark.sparkContext.broadcast(repeated_plane(rows.select(F.col(key).alias("key")), bits).tobytes())

    @F.pandas_udf(T.BooleanType())
    def maybe_repeated(key):
        import pandas as pd

        held = np.frombuffer(shared.value, np.uint8)
        at = probes(key.to_numpy(), bits)
        return pd.Series(((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

    tested = scratch.save(rows.withColumn(maybe, maybe_repeated(key)).drop(key), name)
    shared.destroy()
    return tested


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256, a row for each row; without the text if it isn't wanted.

    Texts are equal when they are identical after each run of ASCII white space becomes one space.
    A null text counts as empty, so null and empty texts are copies of each other; a text of any
    length is hashed whole, once. Of equal texts the row with the smallest id stays; null ids come
    after all others. Where rows repeat that id one of them is kept. Columns of docs named like the
    results are replaced, all others stay; an empty table gives an empty result."""
    scratch, (count, bits) = Scratch(spark), planes_for(docs.count())
    key, maybe, nth = free_names(docs, "__key", "__maybe", "__nth")
    rows = replaced(docs, "keep_id", "group_size", "kept", "text_sha256").withColumn("text_sha256", F.sha2(normalised(text), 256))
    rows = (rows if with_text else rows.drop(text)).withColumn(key, F.xxhash64("text_sha256"))
    # in order within each file, so that a range reads its own part of every file
    rows = scratch.save(rows.sortWithinPartitions(key) if count > 1 else rows, "hashed")
    edges = [-(1 << 63) + (k << 64) // count for k in range(count + 1)]
    parts = [rows.where(F.col(key).between(low, high - 1)) for low, high in zip(edges, edges[1:], strict=False)] if count > 1 else [rows]
    tested = reduce(DataFrame.union, [_tested(spark, scratch, part, bits, f"tested{k}", key, maybe) for k, part in enumerate(parts)])
    scratch.drop("hashed")

    single = tested.where(~F.col(maybe)).drop(maybe).withColumns({"keep_id": F.col(doc_id), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    again = tested.where(F.col(maybe)).drop(maybe)
    # written first: a join of two plain shuffles is one that Spark splits where a text is hot
    groups = scratch.save(again.groupBy("text_sha256").agg(F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    decided = again.join(groups, "text_sha256").withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")))
    decided = scratch.save(decided, "decided")
    # rows that repeat the id that stays are few: one of them is kept
    same_id = Window.partitionBy("text_sha256", doc_id).orderBy(doc_id)
    kept = decided.where("kept").withColumn(nth, F.row_number().over(same_id))
    kept = kept.withColumn("kept", F.col(nth) == 1).drop(nth)
    return single.unionByName(decided.where("NOT kept")).unionByName(kept)


ORACLE = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
