"""Page ranges such as "1,3,5-8": parsing for a caller's argument, and selection over arrays of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ranges(spec: str, last: int) -> list[int]:
    """Distinct pages from 0 in order. Blanks are skipped; what is malformed, reversed, outside 1..last or
    empty as a whole raises."""
    if last < 1:
        raise ValueError("there are no pages")
    pages: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part, re.ASCII)
        if not m:
            raise ValueError(f"{part!r} is not a page or a range of pages")
        low, high = int(m[1]), int(m[2] or m[1])
        if not 1 <= low <= high <= last:
            raise ValueError(f"{part!r} is not within 1-{last}")
        pages.update(range(low - 1, high))
    if not pages:
        raise ValueError("no page is named")
    return sorted(pages)


def ranges(spec: Column, last: Column) -> Column:
    """The same for a column; null where parse_ranges would raise."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    fits = F.forall(parts, lambda p: p.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$"))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    high = lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")
    inside = F.forall(parts, lambda p: (low(p) >= 1) & (low(p) <= high(p)) & (high(p) <= last))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p) - 1, high(p) - 1)))))
    return F.when(F.size(parts) > 0, F.when(fits, F.when(inside, pages)))


def select(pages: Column, chosen: Column) -> Column:
    return F.transform(chosen, lambda i: F.element_at(pages, i + 1))


def delete(pages: Column, gone: Column) -> Column:
    """The pages that stay; null if none would."""
    kept = F.filter(pages, lambda p, i: ~F.array_contains(gone, i))
    return F.when(F.size(kept) > 0, kept)


def reorder(pages: Column, order: Column) -> Column:
    """Pages in the order of their numbers from 1; null unless the order is a permutation."""
    whole = F.array_sort(order) == F.sequence(F.lit(1), F.size(pages))
    return F.when(F.size(pages) > 0, F.when(whole, F.transform(order, lambda i: F.element_at(pages, i))))


def split(pages: Column, specs: Column) -> Column:
    """An array of parts, one for each range of the specification ("1-2;4"); null where a range is wrong."""
    named = F.filter(F.transform(F.split(specs, ";"), lambda s: F.trim(s)), lambda s: s != "")
    chosen = F.transform(named, lambda s: ranges(s, F.size(pages)))
    whole = (F.size(named) > 0) & ~F.exists(chosen, lambda c: c.isNull())
    return F.when(whole, F.transform(chosen, lambda c: select(pages, c)))


def merge(*parts: Column) -> Column:
    """Pages of two to ten files, one file after the other."""
    if not 2 <= len(parts) <= 10:
        raise ValueError("from two to ten files are merged")
    return F.concat(*parts)


def insert_blank(pages: Column, at: Column, count: int = 1) -> Column:
    """count blank pages (1 to 20) before page number at, from 1; one past the last adds them at the end."""
    if not 1 <= count <= 20:
        raise ValueError("from one to twenty blank pages are inserted")
    inside = at.between(1, F.size(pages) + 1)
    return F.when(inside, F.concat(F.slice(pages, F.lit(1), at - 1), F.array(*[F.lit("")] * count), F.slice(pages, at, F.size(pages))))


def rotate(angles: Column, chosen: Column, degrees: int) -> Column:
    """Angles of pages (0 to 270) after those chosen (numbers from 0; null: all) were turned by a multiple of 90 degrees."""
    if degrees % 90:
        raise ValueError("pages turn by multiples of 90 degrees")
    turned = lambda a: F.pmod(F.coalesce(a, F.lit(0)) + degrees, F.lit(360)).cast("int")
    return F.transform(angles, lambda a, i: F.when(chosen.isNull() | F.array_contains(chosen, i), turned(a)).otherwise(F.coalesce(a, F.lit(0))))


def column_letters(index: Column) -> Column:
    """A spreadsheet's column name of a number from 1."""
    steps = F.sequence(F.lit(1), F.lit(7))
    start = F.struct(index.cast("long").alias("n"), F.lit("").alias("s"))

    def step(acc, _):
        n = acc["n"]
        char = F.char(F.lit(65) + (n - 1) % 26)
        more = n > 0
        return F.struct(F.when(more, F.floor((n - 1) / 26)).otherwise(F.lit(0).cast("long")).alias("n"), F.when(more, F.concat(char, acc["s"])).otherwise(acc["s"]).alias("s"))

    return F.aggregate(steps, start, step)["s"]


def column_index(letters: Column) -> Column:
    """The number from 1 of a spreadsheet's column name."""
    codes = F.transform(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: acc * 26 + c)
