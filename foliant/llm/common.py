"""What several operators share: scratch tables, blobs of arrays, union-find, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a worker gives freed buffers back to the system; Arrow's own pools would keep them beside the JVM's heap
pa.set_memory_pool(pa.system_memory_pool())

#: A-Z, the only letters that the text contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch of texts: a worker holds one, and the executor's JVM up to three times as much beside its heap.
BATCH_BYTES = 8 << 20


@contextmanager
def configured(spark: SparkSession, key: str, value: str):
    """The session with a setting, for what runs within."""
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_BYTES for what runs within. Spark's own bound is 10,000 rows, whatever their texts."""
    return configured(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables in the folder that the cluster names in spark.checkpoint.dir, shared by driver and executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
        if not root:  # tests and single machines only
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "/tmp/checkpoints/foliant"
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/foliant-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read again: its lineage ends here and survives lost executors."""
        path = f"{self.root}/{name}"
        # shuffles of this step go as soon as the table stands
        with configured(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that carry the names of results: results replace them."""
    return df.drop(*names)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those asked for that no column of df has."""
    known, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        found.append(name)
    return found


def shards_for(rows: int, per_shard: int) -> int:
    """Number of shards that holds each at about per_shard rows whatever the size of the input."""
    return max(1, -(-rows // per_shard))


def fold_of(doc_id: str = "doc_id", folds: int = 5):
    """crc32(doc_id as text) mod folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


class Numbered(dict):
    """Numbers keys in the order in which they are first seen."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def column_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def unsliced(column: pa.Array) -> pa.Array:
    """A copy that begins with its buffers: string functions misread one that doesn't."""
    return column.take(pa.array(np.arange(len(column)))) if column.offset else column


def words_of(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a batch, lower-cased in A-Z and split at ASCII white space; the number of each
    word of each text in turn; and each text's number of words. Null counts as empty."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(unsliced(column).cast(pa.large_string()).fill_null("")))
    coded = split.flatten().dictionary_encode()
    words, index = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
    counts = split.value_lengths().to_numpy().astype(np.int64)
    if b"" in words:  # at white space before or behind a text
        hole = words.index(b"")
        there = index != hole
        text = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(text[there], minlength=len(counts))
        index = index[there]
        index -= index > hole
        words = words[:hole] + words[hole + 1 :]
    return words, index, counts


def whole(batches) -> pa.Table | None:
    """A task's batches as one table; None if there are no rows."""
    held = [b for b in batches if len(b)]
    return pa.Table.from_batches(held) if held else None


def slices(batch: pa.RecordBatch, text: int, size: int):
    """Parts of a batch with about size bytes of text each."""
    ends = np.cumsum(np.frombuffer(pc.binary_length(batch.column(text)).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)) if len(batch) else np.zeros(0, np.int64)
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        # copied: string functions misread an array that begins within its buffers
        yield batch.take(pa.array(np.arange(at, to)))
        at = to


_kept: dict = {}


def worker_kept(key: str, make: Callable):
    """What a worker keeps from task to task under a key. It keeps one such thing: another key's goes first."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drops what the worker keeps and gives what is free to the system, which malloc would hold back."""
    _kept.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def fresh(batches: Iterable) -> Iterator:
    """A task's batches, in a worker that carries nothing along from tasks of other operators."""
    let_go()
    yield from batches


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one blob."""
    head = [len(arrays)]
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        parts.append(raw.tobytes())
        head += [np.dtype(raw.dtype).num, len(raw)]
    return np.array(head, np.int64).tobytes() + b"".join(parts)


_BY_NUM = {np.dtype(t).num: np.dtype(t) for t in ("u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8", "f4", "f8")}


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = blob
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * count)
    at, out = 8 * len(head), []
    for num, n in head[1:].reshape(-1, 2).tolist():
        kind = _BY_NUM[num]
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each number's component, of 0..n-1 under the links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        differ = low != high
        if not differ.any():
            break
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that is reachable.

    Alternates large and small stars. Each is an aggregate with partial sums and a join of two written
    tables, which Spark splits when a node is hot, so that no node's neighbours meet in one task."""
    e = scratch.save(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges0")
    for k in range(1, rounds + 1):
        if e.isEmpty():
            break
        # large star: every larger neighbour of a node points to the least of its neighbourhood
        both = e.union(e.selectExpr("b AS a", "a AS b"))
        least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"least{k}")
        large = scratch.save(both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct(), f"large{k}")
        # small star: a node and its smaller neighbours point to the least of them
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"low{k}")
        small = large.join(low, "a").where("b <> m").selectExpr("b AS a", "m AS b").union(low.selectExpr("a", "m AS b"))
        new = scratch.save(small.distinct(), f"edges{k}")
        same = new.count() == e.count() and new.exceptAll(e).isEmpty()
        for name in (f"edges{k - 1}", f"least{k}", f"large{k}", f"low{k}"):
            scratch.drop(name)
        e = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.selectExpr("a AS node", "b AS root")


def numbered(scratch: Scratch, groups: DataFrame, name: str) -> DataFrame:
    """groups with node, a number of its own for each row, which stays as it is since the table is written."""
    return scratch.save(groups.withColumn("node", F.monotonically_increasing_id()), name)
