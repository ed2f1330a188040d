"""Turns of conversations in order, however many of them one conversation has."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from foliant.llm.common import Scratch

#: Characters of a text that order rows of one turn and role before the whole text does.
TIE = 64


def ordered(scratch: Scratch, rows: DataFrame, name: str, *last: str) -> DataFrame:
    """rows(conv, turn, role, tie, ...) written with place, a number that rises in order of conv, turn (nulls
    first), role, tie and the columns of last. Ranges of that order are dealt out, so that a conversation with
    very many turns lies in many tasks."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "tie")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, *last)
    return scratch.save(dealt.withColumn("place", F.monotonically_increasing_id()).drop("tie"), name)


def part() -> Column:
    """The task that gave a place."""
    return F.shiftrightunsigned("place", 33)


def stretches(kept: DataFrame) -> DataFrame:
    """(conv, part, first, before, behind): where a conversation begins in each part, the number of its turns in
    earlier parts, and the place of the last of those. A conversation has a row for each part that it is in."""
    runs = kept.groupBy("conv", part().alias("part")).agg(F.min("place").alias("first"), F.max("place").alias("end"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("conv").orderBy("part")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("conv", "part", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.lag("end").over(by).alias("behind"))


def with_stretch(kept: DataFrame) -> DataFrame:
    """kept with first, before and behind of its conversation's stretch."""
    s = stretches(kept).withColumnsRenamed({"conv": "its_conv", "part": "its_part"})
    return kept.join(s, kept["conv"].eqNullSafe(s["its_conv"]) & (part() == F.col("its_part"))).drop("its_conv", "its_part")


def arrow_schema(first: StructField, rest: str) -> pa.Schema:
    """Arrow's schema of a column and of others written as Spark writes them."""
    return to_arrow_schema(StructType([first, *StructType.fromDDL(rest).fields]))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a task, one after the other."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, most: int = 2_000, size: int = 8 << 20, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most so many, or of about so many characters of one of their texts."""
    held, chars = [], 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        chars += len(row[text]) if text is not None else 0
        if len(held) >= most or chars >= size:
            yield give()
            held, chars = [], 0
    if held:
        yield give()


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the crc32 of an ASCII text, by the rule of its polynomial."""
    byte = "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: ascii(x)::UBIGINT)), {byte}), 4294967295::UBIGINT)::BIGINT"
