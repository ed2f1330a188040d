"""Joins and sums in order, for keys of any number of rows.

A window over a key sorts all of its rows in one task. Here rows are dealt by ranges of key and order, so that a hot
key lies in several parts; each part is a window of its own, and what it needs from the parts before it, one row for
each key and part, is carried in by a window over those few rows. The dealt rows are written to the shared folder, so
that parts stay what they are when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.tables import shared_folder


def _names(df: DataFrame, *names: str) -> list[str]:
    """Names like those asked for that no column has."""
    known, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        found.append(name)
    return found


def dealt(rows: DataFrame, by: Sequence[str], order: Sequence[str], part: str) -> DataFrame:
    """rows written with part, the number of the range of (by, order) that they lie in; nulls come first."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/dealt"
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    ranged = rows.repartitionByRange(*keys).withColumn(part, F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], found: str = "found") -> DataFrame:
    """left with the columns of the last row of right that has the same key and comes before or with it in order, and
    found, whether there is one.

    Rows with equal keys and orders on both sides meet: right's comes first. Keys and orders are compared with nulls
    equal and first. Of rows of right that are equal in key and order any may be the last, so order should tell them
    apart. Repeated rows of left stay each; an empty right finds nothing. Columns of left named like the results are
    replaced."""
    part, side, state = _names(left, "part", "side", "state")
    kept = [c for c in left.columns if c not in (*columns, found)]
    own = left.select(*kept)
    one = own.select(*kept, F.lit(1).alias(side), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias(state))
    two = right.select(*[F.col(c) if c in (*by, *order) else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in kept], F.lit(0).alias(side), F.struct(*columns).alias(state))
    rows = dealt(one.union(two), by, order, part)
    at = F.struct(*order, side)
    ends = rows.groupBy(*by, part).agg(F.max_by(state, F.when(F.col(side) == 0, at)).alias(state))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"{c}__c") for c in (*by, part)], F.last(state, ignorenulls=True).over(before).alias(f"{state}__c"))
    inside = Window.partitionBy(part, *by).orderBy(*[F.col(c).asc_nulls_first() for c in order], side).rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn(state, F.last(state, ignorenulls=True).over(inside)).where(F.col(side) == 1)
    joined = told.join(carried, [F.col(c).eqNullSafe(F.col(f"{c}__c")) for c in (*by, part)], "left")
    value = F.coalesce(F.col(state), F.col(f"{state}__c"))
    return joined.select(*kept, *[value[c].alias(c) for c in columns], value.isNotNull().alias(found))


def running_count(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "nth") -> DataFrame:
    """rows with name, the place of each among those of its key in order, from 1; nulls come first."""
    (part,) = _names(rows, "part")
    kept = dealt(rows.drop(name), by, order, part)
    sizes = kept.groupBy(*by, part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(*[F.col(c).alias(f"{c}__c") for c in (*by, part)], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before__c"))
    inside = Window.partitionBy(part, *by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    told = kept.withColumn(name, F.row_number().over(inside)).join(carried, [F.col(c).eqNullSafe(F.col(f"{c}__c")) for c in (*by, part)])
    return told.select(*[c for c in rows.columns if c != name], (F.col(name) + F.col("before__c")).alias(name))
