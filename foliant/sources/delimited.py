"""Delimited files of any size, each read by as many tasks as it has byte ranges.

Spark's text reader deals the ranges of a file out and gives their lines. Whether a range begins inside a quoted cell
depends on all quotes before it: a first pass counts each range's quotes, a prefix sum over the ranges tells the state
in which each begins, and a second pass parses the ranges side by side. A row that goes on in the next range is put
together from its pieces. Rows are numbered by a prefix sum over the ranges' numbers of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.sources.files import PROBLEM, problem, sniff_delimiter, split_rows
from foliant.sources.tables import shared_folder

# a worker gives freed buffers back to the system
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of lines that are parsed at once, and characters of rows that are handed on at once.
PARSED_BYTES, GIVEN_CHARS = 1 << 20, 4 << 20
#: Bytes of a file's beginning whose first rows tell its delimiter (lines from ranges that begin in them), and ranges
#: whose states are broadcast at most.
HEAD_BYTES, MOST_RANGES = 1 << 20, 1_000_000
#: Bytes of a byte-order mark, which Spark's reader takes away: without it a file has as many bytes as its lines, or one less.
BOM = 3
SURVEY = "path string, start long, size long, bytes long, lines long, quotes long, crlf long, cr long, last_cr boolean, head binary"
PARSED = "path string, start long, nth long, delimiter string, cells array<string>, kind string, piece binary"


@dataclass(frozen=True)
class Delimited:
    """rows(path, line from 0, delimiter, cells, problem) and files(path, length, line_ending, has_bom)."""

    rows: DataFrame
    files: DataFrame


def _ranges(batches) -> Iterator[tuple[tuple, pa.Array]]:
    """((path, start, further columns), lines) of stretches of a task's lines that lie in one range, of a bounded size."""
    for batch in batches:
        if not len(batch):
            continue
        path, start = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        upto = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64)) // PARSED_BYTES
        cuts = np.flatnonzero((np.diff(path) != 0) | (np.diff(start) != 0) | (np.diff(upto) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            part = batch.slice(a, b - a)
            yield tuple(c[0].as_py() for c in part.columns[:-1]), part.column(part.num_columns - 1)


def _surveyed(batches):
    """A row of SURVEY for each range of a task."""
    names = [x.split()[0] for x in SURVEY.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 7, pa.bool_(), pa.binary()]
    found: list[list] = []
    head: list[bytes] = []
    room = 0
    add = lambda x: int(pc.sum(x).as_py() or 0)
    for (path, start, size), lines in _ranges(batches):
        if not found or found[-1][:2] != [path, start]:
            if found:
                found[-1][9] = b"".join(head)
            found.append([path, start, size, 0, 0, 0, 0, 0, False, b""])
            head, room = [], HEAD_BYTES - start
        row = found[-1]
        if room > 0:
            for line in lines.to_pylist():
                head.append(line[:room] + b"\n")
                room -= len(line) + 1
                if room <= 0:
                    break
        row[3] += add(pc.binary_length(lines)) + len(lines)
        row[4] += len(lines)
        row[5] += add(pc.count_substring(lines, '"'))
        row[6] += add(pc.ends_with(lines, "\r").cast(pa.int64()))
        row[7] += add(pc.count_substring(lines, "\r"))
        row[8] = lines[len(lines) - 1].as_py().endswith(b"\r")
    if found:
        found[-1][9] = b"".join(head)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)


def _sniffed(batches):
    """(path, delimiter) of files (path, heads), whose heads are of HEAD_BYTES together."""
    for batch in batches:
        rows = []
        for path, heads in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text = b"".join(h["head"] for h in heads)
            rows.append((path, sniff_delimiter(text.decode("utf-8", "replace"))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "delimiter"])


class _Range:
    """Parses the lines of a range from the state in which it begins."""

    def __init__(self, start: int, delimiter: str, inside: bool) -> None:
        self.start, self.delimiter, self.inside = start, delimiter, inside
        self.joining = inside  # the lines so far end a row of an earlier range
        self.held: list[bytes] = []
        self.nth = 0

    def take(self, lines: pa.Array) -> Iterator[tuple]:
        texts = lines.to_pylist()
        after = (int(self.inside) + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) % 2
        whole = np.flatnonzero(after == 0)
        self.inside = bool(after[-1]) if len(after) else self.inside
        if not len(whole):
            self.held += texts
            return
        first, last = int(whole[0]) + 1, int(whole[-1]) + 1
        if self.joining:
            yield None, "head", self.joined(texts[:first])
            self.joining = False
            texts, last = texts[first:], last - first
        text = self.joined(texts[:last])
        self.held = texts[last:]
        for cells in split_rows(text.decode("utf-8", "replace"), self.delimiter):
            yield self.nth, cells, None
            self.nth += 1

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield None, "through" if self.joining else "tail", self.joined([])

    def joined(self, more: list[bytes]) -> bytes:
        lines, self.held = self.held + more, []
        return b"".join(x + b"\n" for x in lines)


def _parsed(batches):
    """Rows of PARSED: those that begin and end in the range, and pieces of others."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.binary()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    at, part, rows, chars = None, None, [], 0

    def told(found):
        nonlocal chars
        path, start = at
        for nth, what, piece in found:
            rows.append((path, start, nth, part.delimiter, None if nth is None else what, what if nth is None else None, piece))
            chars += len(piece) if nth is None else sum(map(len, what))
            if len(rows) >= 5000 or chars >= GIVEN_CHARS:
                yield give(rows)
                rows.clear()
                chars = 0

    for (path, start, delimiter, inside), lines in _ranges(batches):
        if at != (path, start):
            if part is not None:
                yield from told(part.end())
            at, part = (path, start), _Range(start, delimiter, inside)
        yield from told(part.take(lines))
    if part is not None:
        yield from told(part.end())
    if rows:
        yield give(rows)


def _stitched(batches):
    """Rows (path, start, nth, delimiter, cells) of runs of pieces (path, start, delimiter, open, pieces)."""
    names, kinds = ["path", "start", "nth", "delimiter", "cells"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
    for batch in batches:
        for path, start, delimiter, unended, pieces in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text = b"".join(p["piece"] for p in pieces)
            text = text[:-1] if unended else text
            rows = [(path, start, n, delimiter, cells) for n, cells in enumerate(split_rows(text.decode("utf-8", "replace"), delimiter))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _unended(bytes_: Column, size: Column) -> Column:
    """Whether a file's last line has no end, by the bytes of its lines with an end each."""
    return bytes_ + F.when(bytes_ < size, BOM).otherwise(0) > size


def _line_ending(lines: Column, crlf: Column, cr: Column) -> Column:
    kinds = [F.when(n > 0, name) for n, name in ((crlf, "crlf"), (lines - crlf, "lf"), (cr, "cr"))]
    found = F.array_compact(F.array(*kinds))
    return F.when(F.size(found) == 0, "none").when(F.size(found) > 1, "mixed").otherwise(F.element_at(found, 1))


def read_delimited(spark: SparkSession, path: str, glob: str | None = None, range_bytes: int | None = None) -> Delimited:
    """The delimited files below path, whose rows are written to the shared folder once.

    Lines end in LF or CRLF; a CR alone ends a row too, but a file whose lines all end so is a single range. A quote
    opens or closes anywhere, doubled ones in quotes are one, quoted line ends stay, rows of one empty cell are left
    out. Bytes that aren't UTF-8 become U+FFFD. A quote that nothing closes holds the rest of the file. A file's
    delimiter is told by its first 50 rows, as far as they lie in HEAD_BYTES. A file without rows is one row with a
    problem; files of no bytes aren't listed by Spark's readers. A range is as long as range_bytes, or as
    spark.sql.files.maxPartitionBytes says; a task holds a row and a batch of lines."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_block_start", "start"), ("file_size", "size"))]
    lines = reader.option("lineSep", "\n").text(path).select(*meta, F.col("value").cast("binary").alias("line"))
    folder = shared_folder(spark)

    def saved(df: DataFrame, name: str, ranges: int | None = None) -> DataFrame:
        key = "spark.sql.files.maxPartitionBytes"
        before = spark.conf.get(key)
        try:
            spark.conf.set(key, str(ranges) if ranges else before)
            df.write.parquet(f"{folder}/{name}")
        finally:
            spark.conf.set(key, before)
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    survey = saved(lines.mapInArrow(_surveyed, SURVEY), "survey", range_bytes)
    heads = survey.where(F.col("start") < HEAD_BYTES).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "head"))).alias("heads"))
    sniffed = saved(heads.mapInArrow(_sniffed, "path string, delimiter string"), "sniffed")
    by = Window.partitionBy("path").orderBy("start")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    states = survey.select(
        "path", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        _unended(F.sum("bytes").over(whole), F.col("size")).alias("unended"),
    )
    states = saved(states.join(sniffed, "path"), "states")
    told = states.select("path", "start", "delimiter", "inside")
    if states.count() <= MOST_RANGES:
        ready = lines.drop("size").join(F.broadcast(told), ["path", "start"])
    else:  # lines meet their states in a shuffle and are put in order again
        ready = lines.drop("size").withColumn("nth", F.monotonically_increasing_id()).join(told, ["path", "start"])
        ready = ready.repartition("path", "start").sortWithinPartitions("path", "start", "nth")
    parsed = saved(ready.select("path", "start", "delimiter", "inside", "line").mapInArrow(_parsed, PARSED), "parsed", range_bytes)

    pieces = parsed.where("piece IS NOT NULL").withColumn("late", F.col("kind") == "tail")
    run = F.last(F.when(F.col("late"), F.col("start")), ignorenulls=True).over(Window.partitionBy("path").orderBy("start", "late"))
    runs = pieces.withColumn("run", run).groupBy("path", "run").agg(F.first("delimiter").alias("delimiter"), (~F.bool_or(F.col("kind") == "head")).alias("open"), F.array_sort(F.collect_list(F.struct("start", "late", "piece"))).alias("pieces"))
    ends = states.groupBy("path").agg(F.first("unended").alias("unended"))
    runs = runs.join(ends, "path").select("path", F.col("run").alias("start"), "delimiter", (F.col("open") & F.col("unended")).alias("unended"), "pieces")
    joined = saved(runs.mapInArrow(_stitched, "path string, start long, nth long, delimiter string, cells array<string>"), "joined")

    # what begins in a range before it ends comes before what goes on
    columns = ["path", "start", "nth", "delimiter", "cells"]
    every = parsed.where("nth IS NOT NULL").select(*columns, F.lit(False).alias("goes_on")).union(joined.select(*columns, F.lit(True).alias("goes_on")))
    sizes = every.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("goes_on"), 1)).alias("own"))
    offsets = saved(sizes.select("path", "start", "own", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    line = F.col("offset") + F.col("nth") + F.when(F.col("goes_on"), F.col("own")).otherwise(0)
    rows = every.join(offsets, ["path", "start"]).select("path", line.alias("line"), "delimiter", "cells", F.lit(None).cast(PROBLEM).alias("problem"))

    sums = survey.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("length"), F.sum("lines").alias("lines"), F.sum("crlf").alias("crlf"), F.sum("cr").alias("cr"), F.max_by("last_cr", "start").alias("last_cr"))
    empty = sums.select("path").join(sizes.select("path").distinct(), "path", "left_anti")
    none = empty.select("path", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("delimiter"), F.lit(None).cast("array<string>").alias("cells"), problem(422, F.lit("the file holds no rows")).alias("problem"))
    # the last line may have no end
    short = _unended(F.col("bytes"), F.col("length"))
    crlf = F.col("crlf") - (short & F.col("last_cr")).cast("long")
    ending = _line_ending(F.col("lines") - short.cast("long"), crlf, F.col("cr") - crlf)
    return Delimited(rows.union(none), sums.join(sniffed, "path").select("path", "length", ending.alias("line_ending"), (F.col("bytes") < F.col("length")).alias("has_bom")))
