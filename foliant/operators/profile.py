"""Profiles of delimited data whose cells are text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text

#: Distinct values that a profile counts at most, and samples it keeps by default.
MOST_DISTINCT, SAMPLES, MOST_SAMPLES = 10_000, 5, 20
#: Logarithm of the smallest hashes that a sketch keeps of a column: fewer distinct values than 16,384 are counted exactly.
KEPT_HASHES = 14
#: Files whose first values a task holds before it hands them on.
HELD_FILES = 10_000
#: Supported numbers (thousands, brackets, exponent, sign before or behind, currency) and integers.
NUMBER = r"^\s*[-+(]?\s*[$¤]?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?([eE][-+]?\d+)?\s*[-+)]?\s*$"
INTEGER = r"^\s*[-+]?\d{1,18}\s*$"
#: Supported dates, each with a time or without: year first, day and month name, month first with slashes.
_TIME = r"([ T]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,7})?)?)?"
_MONTH = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = (
    (rf"^\d{{4}}[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01]){_TIME}$", "yyyy-M-d"),
    (rf"^(0?[1-9]|[12]\d|3[01]) {_MONTH} \d{{4}}{_TIME}$", "d MMM yyyy"),
    (rf"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/\d{{4}}{_TIME}$", "M/d/yyyy"),
)
BOOLEAN = r"^\s*([tT][rR][uU][eE]|[fF][aA][lL][sS][eE]|0|1|yes|no|Y|N)\s*$"


def is_number(v: Column) -> Column:
    return v.rlike(NUMBER) & v.rlike(r"\d")


def to_number(v: Column) -> Column:
    bare = F.regexp_replace(v, r"[\s,$¤()+]", "")
    digits = F.regexp_replace(bare, r"^-|-$", "").try_cast("double")
    return F.when(v.contains("(") | bare.rlike("^-|-$"), -digits).otherwise(digits)


def to_date(v: Column) -> Column:
    """The date and time of a value in ISO form; null if it isn't one."""
    v = F.trim(v)
    time = F.regexp_extract(v, r"[ T](\d{1,2}:\d\d(?::\d\d)?(?:\.\d+)?)$", 1)
    said = F.lit(None).cast("string")
    for pattern, form in reversed(DATES):
        day = F.try_to_timestamp(F.replace(F.regexp_replace(v, r"[ T]\d{1,2}:.*$", ""), F.lit("/"), F.lit("-" if form.startswith("y") else "/")), F.lit(form))
        said = F.when(v.rlike(pattern), F.date_format(day, "yyyy-MM-dd")).otherwise(said)
    clock = F.when(F.length(time) > 5, F.lpad(time, 8, "0")).otherwise(F.concat(F.lpad(time, 5, "0"), F.lit(":00")))
    return F.concat(said, F.when(time == "", "T00:00:00").otherwise(F.concat(F.lit("T"), F.when(time.contains("."), time).otherwise(clock))))


def cells(df: DataFrame, *names: str) -> DataFrame:
    """A row (position, name, value) for each cell of the named columns as text; one pass over df."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.col(f"`{n}`").cast("string").alias("value")) for i, n in enumerate(names)])
    return df.select(F.explode(pairs).alias("c")).select("c.*")


def profile(rows: DataFrame) -> DataFrame:
    """For rows (position, name, value): non_empty, empty, distinct_count, inferred_type, min and max.

    One aggregate, in which a task sums a column up in a row with a sketch of its smallest hashes, so that what
    is shuffled follows the columns and not their values. Below MOST_DISTINCT the sketch counts exactly. Numbers are
    compared as doubles, so that ends beyond 2^53 are rounded, dates in ISO form, and of other text the lengths count;
    booleans and empty columns have no range."""
    v = F.col("value")
    each = rows.select("position", "name", F.coalesce("value", F.lit("")).alias("value"))
    full = F.trim(v) != ""
    each = each.withColumns({"n": F.lit(1), "full": full, "number": F.when(full & is_number(v), to_number(v)), "int": full & v.rlike(INTEGER), "bool": full & v.rlike(BOOLEAN), "date": F.when(full, to_date(v))})
    every = lambda c: F.coalesce(F.every(F.when(F.col("full"), F.col(c).isNotNull() if c in ("number", "date") else F.col(c))), F.lit(False))
    of = lambda x: F.when(F.col("full"), x)
    distinct = F.least(F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(of(v), KEPT_HASHES)), F.lit(0)), F.lit(MOST_DISTINCT)).cast("long")
    got = each.groupBy("position", "name").agg(
        F.coalesce(F.sum(F.when(F.col("full"), F.col("n"))), F.lit(0)).alias("non_empty"),
        F.coalesce(F.sum(F.when(~F.col("full"), F.col("n"))), F.lit(0)).alias("empty"),
        distinct.alias("distinct_count"),
        every("number").alias("numbers"), every("int").alias("ints"), every("bool").alias("bools"), every("date").alias("dates"),
        F.min("number").alias("low"), F.max("number").alias("high"),
        F.min("date").alias("first"), F.max("date").alias("last"),
        F.min(of(F.length(v))).alias("short"), F.max(of(F.length(v))).alias("long"),
    )
    kind = (
        F.when(F.col("non_empty") == 0, "empty")
        .when(F.col("numbers") & F.col("ints"), "integer")
        .when(F.col("numbers"), "decimal")
        .when(F.col("bools"), "boolean")
        .when(F.col("dates"), "date")
        .otherwise("string")
    )

    def edge(number: str, date: str, length: str) -> Column:
        shown = F.when(F.col("ints"), F.col(number).cast("long").cast("string")).otherwise(F.col(number).cast("string"))
        return F.when(F.col("inferred_type").isin("integer", "decimal"), shown).when(F.col("inferred_type") == "date", F.col(date)).when(F.col("inferred_type") == "string", F.col(length).cast("string"))

    got = got.withColumn("inferred_type", kind)
    return got.select("position", "name", "non_empty", "empty", "distinct_count", "inferred_type", edge("low", "first", "short").alias("min_value"), edge("high", "last", "long").alias("max_value"))


def header_like(first: Column) -> Column:
    """Whether a first row of cells is a header: it has cells, and none is blank or a number."""
    return (F.size(first) > 0) & ~F.exists(first, lambda c: (F.trim(c) == "") | is_number(c))


def duplicate_headers(headers: Column) -> Column:
    """Names that come twice or more, in the spelling of their first place; case and blanks around don't count."""
    named = F.transform(headers, lambda h, i: F.struct(F.lower(F.trim(h)).alias("low"), i.alias("i"), F.trim(h).alias("h")))

    def repeated(s: Column) -> Column:
        low = lambda i: F.get(s, i)["low"]
        first = F.filter(s, lambda x, i: (x["low"] != "") & ~F.coalesce(low(i - 1) == x["low"], F.lit(False)) & F.coalesce(low(i + 1) == x["low"], F.lit(False)))
        return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h")))), lambda x: x["h"])

    return text.bound(F.array_sort(named), repeated)


def inspect(rows: DataFrame, *file: str) -> DataFrame:
    """Per file of rows (file..., line, cells): row_count, column_count (of the first row), headers (columnN
    without a header), has_header, data_row_count, ragged_rows and first_ragged. Rows are summed up by
    their width first, so that a file of any length is a few rows after the first step."""
    by_width = rows.groupBy(*file, F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.min_by("cells", "line").alias("cells"))
    per = by_width.groupBy(*file).agg(F.sum("n").alias("row_count"), F.min_by("cells", "line").alias("first"), F.collect_list(F.struct("width", "n", "line")).alias("widths"))
    ragged = F.filter("widths", lambda w: w["width"] != F.size("first"))
    header = header_like(F.col("first"))
    numbered = F.transform(F.sequence(F.lit(1), F.size("first")), lambda i: F.concat(F.lit("column"), i.cast("string")))
    return per.select(
        *file, "row_count", F.size("first").alias("column_count"), F.when(header, F.col("first")).otherwise(numbered).alias("headers"), header.alias("has_header"),
        F.aggregate(ragged, F.lit(0).cast("long"), lambda acc, w: acc + w["n"]).alias("ragged_rows"), (F.array_min(F.transform(ragged, lambda w: w["line"])) + 1).alias("first_ragged"),
    ).withColumn("data_row_count", F.col("row_count") - F.col("has_header").cast("int"))


def inspection(files: DataFrame, lines: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Per file: what inspect tells, delimiter, line_ending, has_bom, and issues (check, severity, message): empty
    files, ragged rows, repeated headers, no header (a row with a blank cell is none), mixed line ends. files has either
    the content or line_ending and has_bom."""
    raw = F.col(content)
    if content in files.columns:
        files = files.select(key, text.line_ending(raw.cast("string")).alias("line_ending"), (F.hex(F.substring(raw, 1, 3)) == "EFBBBF").alias("has_bom"))
    bytes_ = files.select(key, "line_ending", "has_bom")
    good = lines.where("problem IS NULL")
    told = bytes_.join(inspect(good, key), key, "left").join(good.groupBy(key).agg(F.max("delimiter").alias("delimiter")), key, "left")
    told = told.withColumns({"row_count": F.coalesce("row_count", F.lit(0)), "data_row_count": F.coalesce("data_row_count", F.lit(0))})
    twice = duplicate_headers(F.col("headers"))

    def issue(check: str, severity: str, when: Column, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message")))

    issues = F.array(
        issue("empty", "error", F.col("row_count") == 0, F.lit("no rows")),
        issue("ragged_rows", "error", F.col("ragged_rows") > 0, F.format_string("%d rows haven't %d cells; the first is row %d", "ragged_rows", "column_count", "first_ragged")),
        issue("header", "warning", F.col("has_header") & (F.size(twice) > 0), F.concat(F.lit("repeated: "), F.array_join(twice, ", "))),
        issue("header", "info", ~F.col("has_header"), F.lit("no header; columns are numbered")),
        issue("line_endings", "warning", F.col("line_ending") == "mixed", F.lit("line ends differ")),
    )
    return told.withColumn("issues", F.array_compact(issues))


def first_values(rows: DataFrame, key: str, samples: int) -> DataFrame:
    """(key, position, samples): the first values of each column of rows (key, line, cells) that aren't blank, in order
    of lines, wherever they are. A task keeps as many of each column as are asked for, and so does the aggregate."""
    kind, line_kind = (rows.schema[c].dataType.simpleString() for c in (key, "line"))

    def firsts(batches):
        held: dict = {}
        for batch in batches:
            for name, line, cells in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                columns = held.setdefault(name, [])
                columns += [[] for _ in range(len(cells) - len(columns))]
                for best, value in zip(columns, cells, strict=False):
                    if (len(best) < samples or line < best[-1][0]) and (value or "").strip(" "):
                        del best[samples - 1 :]
                        best.append((line, value))
                        best.sort()
            if len(held) > HELD_FILES:
                yield from told(held, batch.schema)
                held = {}
        if held:
            yield from told(held, batch.schema)

    def told(held, schema):
        found = [(name, position, *one) for name, columns in held.items() for position, best in enumerate(columns) for one in best]
        if found:
            types = (schema.field(0).type, pa.int32(), schema.field(1).type, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [key, "position", "line", "value"])

    some = rows.select(key, "line", "cells").mapInArrow(firsts, f"`{key}` {kind}, position int, line {line_kind}, value string")
    by = Window.partitionBy(key, "position").orderBy("line")
    best = some.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= samples)
    return best.groupBy(key, "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("samples"))


def profile_files(lines: DataFrame, key: str = "path", samples: int = SAMPLES) -> DataFrame:
    """The columns of every file of lines (key, line, cells): what profile tells, and samples, the first values in
    the order of lines (20 at most). Columns are as many as the widest row has. A first row that looks like a header
    is none of the data; it names the columns if it is as wide, else they are column1 and so on. Files without rows
    are left out."""
    good = lines.where("problem IS NULL")
    samples = min(max(samples, 0), MOST_SAMPLES)
    about = good.groupBy(key).agg(F.max(F.size("cells")).alias("width"), F.min_by("cells", "line").alias("first"))
    about = about.withColumn("headed", header_like(F.col("first"))).withColumn("first", F.when(F.col("headed") & (F.size("first") == F.col("width")), F.col("first")))
    rows = good.join(about, key).where("line > 0 OR NOT headed")
    at = F.posexplode(F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))).alias("position", "value")
    name = F.coalesce(F.try_element_at("first", F.col("position") + 1), F.concat(F.lit("column"), (F.col("position") + 1).cast("string")))
    told = profile(rows.select(key, "first", at).select(F.struct(key, "position").alias("position"), name.alias("name"), "value"))
    out = told.select(f"position.{key}", "position.position", *told.columns[1:])
    if not samples:
        return out.withColumn("samples", F.array().cast("array<string>"))
    return out.join(first_values(rows, key, samples), [key, "position"], "left")


def data_rows(lines: DataFrame, limit: int | None = None, key: str = "path") -> DataFrame:
    """Rows of every file below its header, at most limit of each (none or less: all), as (key, row, cells); a file
    without rows is one row with a problem, and so is a broken one."""
    good = lines.where("problem IS NULL")
    head = good.where("line = 0").select(key, header_like(F.col("cells")).alias("named"))
    rows = good.join(head, key).withColumn("row", F.col("line") - F.col("named").cast("int")).where("row >= 0")
    rows = rows if limit is None or limit <= 0 else rows.where(F.col("row") < limit)
    broken = lines.where("problem IS NOT NULL").select(key, F.lit(None).cast("int"), F.lit(None).cast("array<string>"), "problem")
    return rows.select(key, "row", "cells", "problem").union(broken)
