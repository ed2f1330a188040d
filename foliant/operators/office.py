"""Aggregates over the contents of office files and books, as sources.files gives them."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliant.functions import html, spans, text
from foliant.sources import files

#: Functions that reach outside a workbook, the first that a formula holds counts.
RISKY = ("WEBSERVICE", "FILTERXML", "RTD", "DDE", "DDEAUTO", "CALL", "REGISTER.ID", "EXEC")
SHOWN = 500


def sheets(rows: DataFrame, key: str = "path") -> DataFrame:
    """Of each sheet, those without rows too: position, visibility, row, cell and formula counts, and the most cells of a row."""
    return _sheets(rows, key)


def _sheets(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    formulas = F.size(F.filter("formulas", lambda f: f.isNotNull()))
    return rows.where("problem IS NULL").groupBy(key, "sheet").agg(
        F.min("position").alias("position"),
        F.first("visibility").alias("visibility"),
        F.count("row_index").alias("row_count"),
        F.sum(F.size("cells")).alias("cell_count"),
        F.sum(formulas).alias("formula_count"),
        F.max(F.size("cells")).alias("column_count"),
        *more,
    )


def workbook_metrics(rows: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """Of each workbook: sheets, visible and hidden ones, rows, cells, formulas, defined names, and the words and
    characters of all cells. Sums over rows and facts, each read once, so that no workbook's text is put together."""
    said = [F.sum(text.word_count(F.array_join("cells", " "))).alias("words"), F.sum(F.length(F.array_join("cells", ""))).alias("chars")]
    some = _sheets(rows, key, *said).groupBy(key).agg(
        F.count(F.lit(1)).alias("sheets"), F.count(F.when(F.col("visibility") != "visible", 1)).alias("hidden_sheets"),
        F.sum("row_count").alias("rows"), F.sum("cell_count").alias("cells"), F.sum("formula_count").alias("formulas"), F.sum("words").alias("words"), F.sum("chars").alias("chars"),
    )
    names = facts.groupBy(key).agg(F.count(F.when(F.col("kind") == "defined_name", 1)).alias("defined_names"))
    return some.join(names, key, "left").withColumns({"defined_names": F.coalesce("defined_names", F.lit(0)), "visible_sheets": F.col("sheets") - F.col("hidden_sheets")})


def read_sheet(rows: DataFrame, sheet: str | int | None = None, limit: int = 10_000, key: str = "path") -> DataFrame:
    """Rows of one sheet of each workbook, by its name in any case, its number from 0, or the first one: key,
    sheet, row_index, cells padded to the widest row read, and problem where the workbook hasn't got it, which
    names the sheets it has. limit is held to 1..100,000."""
    limit = min(max(limit, 1), 100_000)
    good = rows.where("problem IS NULL")
    wanted = F.col("position") == (sheet or 0) if not isinstance(sheet, str) else F.lower("sheet") == sheet.lower()
    some = good.where(wanted & (F.col("row_index") < limit))
    width = some.groupBy(key).agg(F.max(F.size("cells")).alias("width"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    none = F.lit(None).cast(files.PROBLEM)
    read = some.join(width, key).select(key, "sheet", "row_index", padded.alias("cells"), none.alias("problem"))
    has = good.groupBy(key).agg(F.max(wanted).alias("found"), F.array_sort(F.collect_set("sheet")).alias("names")).where("NOT found")
    missing = has.select(key, F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("array<string>"), files.problem(404, F.concat(F.lit("the sheets are: "), F.array_join("names", ", "))))
    broken = rows.where("problem IS NOT NULL").select(key, F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("array<string>"), "problem")
    return read.union(missing).union(broken)


def sheet_markdown(rows: DataFrame, key: str = "path") -> DataFrame:
    """Markdown of each sheet: its name as a heading, then a table whose first row is the header, or _(empty)_.
    Rows are padded to the widest one. A sheet is one cell of text."""
    cell = lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "[\r\n]+", " ")
    good = rows.where("problem IS NULL")
    parts = F.array_sort(F.collect_list(F.when(F.col("row_index").isNotNull(), F.struct("row_index", "cells"))))
    got = good.groupBy(key, "position", "sheet").agg(parts.alias("parts"), F.max(F.size("cells")).alias("width"))
    line = lambda p: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(p["cells"], cell), F.array_repeat(F.lit(""), F.col("width") - F.size(p["cells"]))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), F.col("width")), ""))
    lines = F.transform("parts", line)
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")
    body = F.when(F.size("parts") > 0, table).otherwise("_(empty)_")
    return got.select(key, "position", "sheet", F.concat(F.lit("## "), "sheet", F.lit("\n\n"), body).alias("markdown"))


def risky(formula: Column) -> Column:
    """The first risky function whose name the formula holds, in any case."""
    found = F.lit(None).cast("string")
    for name in reversed(RISKY):
        found = F.when(F.upper(formula).contains(name), name).otherwise(found)
    return found


def risky_formulas(rows: DataFrame, key: str = "path") -> DataFrame:
    """A row for each risky formula: sheet, row, cell from 0, function and the formula, cut to SHOWN characters."""
    each = rows.where("problem IS NULL").select(key, "sheet", "row_index", F.posexplode("formulas").alias("cell", "formula"))
    return each.withColumn("function", risky(F.col("formula"))).where("function IS NOT NULL").withColumn("formula", F.substring("formula", 1, SHOWN))


def hidden(rows: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """A row for each hidden sheet, row and range of columns: kind, sheet, place (visibility, row number or
    letters) and count."""
    sheet = facts.where("kind = 'sheet' AND name <> 'visible'").select(key, F.lit("sheet").alias("kind"), "sheet", F.col("name").alias("place"), "count")
    row = rows.where("hidden").select(key, F.lit("row").alias("kind"), "sheet", F.col("row_number").cast("string").alias("place"), F.lit(1).alias("count"))
    column = facts.where("kind = 'hidden_column'").select(key, F.lit("column").alias("kind"), "sheet", F.col("name").alias("place"), "count")
    return sheet.union(row).union(column)


def link_audit(rows: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """What reaches outside each workbook: kind (external, hyperlink, risky_formula or macros), sheet, place and target."""
    linked = facts.where("kind IN ('external', 'hyperlink', 'macros')").select(key, "kind", "sheet", F.col("name").alias("place"), F.col("value").alias("target"))
    formula = F.posexplode(F.arrays_zip("formulas", "places")).alias("cell", "f")
    each = rows.where("problem IS NULL").select(key, "sheet", formula).select(key, "sheet", "f.places", "f.formulas").where(risky(F.col("formulas")).isNotNull())
    return linked.union(each.select(key, F.lit("risky_formula").alias("kind"), "sheet", F.col("places").alias("place"), F.concat(risky(F.col("formulas")), F.lit(": "), F.substring("formulas", 1, SHOWN)).alias("target")))


def _issue(check: str, severity: str, when: Column, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message")))


def _judged(df: DataFrame, *key: str, by: tuple[str, ...]) -> DataFrame:
    """df(key, issues) with the counts of each severity, and healthy where none of by is among them."""
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    told = df.select(*key, F.array_compact("issues").alias("issues")).withColumns({"errors": count("error"), "warnings": count("warning"), "infos": count("info")})
    return told.withColumn("healthy", sum((F.col(c) for c in by), F.lit(0)) == 0)


def workbook_health(rows: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """Of each workbook: issues, errors, warnings, infos and healthy, which only errors spoil. Macros, external
    workbooks and risky formulas are warnings, what is hidden is an info, a broken workbook is an error."""
    outside = link_audit(rows, facts, key).groupBy(key).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("external", "risky_formula", "macros")])
    unseen = hidden(rows, facts, key).groupBy(key).agg(*[F.sum(F.when(F.col("kind") == k, F.col("count")).otherwise(0)).alias(f"hidden_{k}s") for k in ("sheet", "row", "column")])
    books = rows.groupBy(key).agg(F.max("problem.detail").alias("broken"))
    all_ = books.join(outside, key, "left").join(unseen, key, "left").fillna(0)
    n = F.col
    issues = F.array(
        _issue("macros", "warning", n("macros") > 0, F.lit("carries macros")),
        _issue("external_links", "warning", n("external") > 0, F.format_string("%d external workbooks", "external")),
        _issue("risky_formulas", "warning", n("risky_formula") > 0, F.format_string("%d formulas reach outside", "risky_formula")),
        _issue("hidden_content", "info", n("hidden_sheets") + n("hidden_rows") + n("hidden_columns") > 0, F.format_string("%d sheets, %d rows, %d columns are hidden", "hidden_sheets", "hidden_rows", "hidden_columns")),
        _issue("structure", "error", n("broken").isNotNull(), n("broken")),
    )
    return _judged(all_.select(key, issues.alias("issues")), key, by=("errors",))


def document_metrics(paragraphs: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """Of each document: paragraphs with text, headings, table rows, words, characters, pages (as the file tells)."""
    said = F.col("text")
    some = paragraphs.where("problem IS NULL").groupBy(key).agg(
        F.count(F.when(~text.is_blank(said), 1)).alias("paragraphs"), F.count(F.when(F.col("style").rlike("^Heading[1-6]$"), 1)).alias("headings"),
        F.count(F.when(F.col("style") == "Table", 1)).alias("table_rows"), F.sum(text.word_count(said)).alias("words"), F.sum(F.length(said)).alias("chars"),
    )
    pages = facts.where("kind = 'property' AND name = 'Pages'").groupBy(key).agg(F.max(F.col("value").try_cast("int")).alias("pages"))
    return some.join(pages, key, "left")


def _languages(rows: DataFrame, key: str, said: Column) -> DataFrame:
    """(key, language) by the function words of all rows, summed up, so that no file's text is put together."""
    marks = rows.where("problem IS NULL").select(key, said.alias("said")).select(key, F.length(F.trim("said")).alias("n"), text.marker_counts(F.col("said")).alias("m"))
    sums = marks.groupBy(key).agg(F.sum(F.col("n") + 1).alias("n"), F.struct(*[F.sum(F.coalesce(F.col("m")[k], F.lit(0))).alias(k) for k in text.MARKERS]).alias("m"))
    return sums.select(key, F.when(F.col("n") > text.LEAST_LENGTH, text.bound(F.col("m"), text.most_marked)).alias("language"))


def _dates(properties: DataFrame, key: str) -> DataFrame:
    """(key, created, modified) as the file's properties (key, name, value) tell them."""
    told = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    return properties.groupBy(key).agg(told("created"), told("modified"))


def document_details(paragraphs: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """Of each document: all_paragraphs (those in tables and blank ones too), tables, images, language, created, modified."""
    n = lambda name: F.coalesce(F.max(F.when((F.col("kind") == "count") & (F.col("name") == name), F.col("value").try_cast("long"))), F.lit(0))
    good = facts.where("problem IS NULL")
    counts = good.groupBy(key).agg(n("paragraphs").alias("all_paragraphs"), n("tables").alias("tables"), F.count(F.when(F.col("kind") == "image", 1)).alias("images"))
    return counts.join(_languages(paragraphs, key, F.col("text")), key, "left").join(_dates(good.where("kind = 'property'"), key), key, "left")


def slide_details(slides: DataFrame, properties: DataFrame, key: str = "path") -> DataFrame:
    """Of each presentation: shapes, pictures, tables, language, created, modified. properties are those of files' contents."""
    counts = slides.where("problem IS NULL").groupBy(key).agg(*[F.sum(c).alias(c) for c in ("shapes", "pictures", "tables")])
    said = _languages(slides, key, F.concat_ws("\n", "text", "notes"))
    return counts.join(said, key).join(_dates(properties.where("problem IS NULL"), key), key, "left")


def workbook_details(rows: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """Of each workbook: language of all cells, created, modified."""
    said = F.array_join("cells", " ")
    dates = _dates(facts.where("problem IS NULL AND kind = 'property'"), key)
    return _languages(rows, key, F.coalesce(said, F.lit(""))).join(dates, key, "left")


def document_markdown(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """Markdown of each document: blocks parted by a blank line, rows of a table by a line end."""
    parts = F.array_sort(F.collect_list(F.when(F.trim("markdown") != "", F.struct("paragraph", (F.col("style") == "Table").alias("row"), "markdown"))))
    joined = F.array_join(F.transform("parts", lambda p, i: F.concat(F.when(i == 0, "").when(F.coalesce(p["row"] & F.element_at("parts", F.greatest(i, F.lit(1)))["row"], F.lit(False)) & ~p["markdown"].contains("\n| --- "), "\n").otherwise("\n\n"), p["markdown"])), "")
    return paragraphs.where("problem IS NULL").groupBy(key).agg(parts.alias("parts")).select(key, joined.alias("markdown"))


def document_health(paragraphs: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """Of each document: issues, their counts and healthy, which errors and warnings spoil."""
    said = paragraphs.groupBy(key).agg(F.max("problem.detail").alias("broken"), F.max("tracked").alias("tracked"), F.sum("drawings").alias("drawings"))
    about = facts.groupBy(key).agg(F.count(F.when(F.col("kind") == "package", 1)).alias("packages"), F.count(F.when(F.col("kind") == "image", 1)).alias("images"), F.count(F.when(F.col("name") == "created", 1)).alias("created"))
    all_ = said.join(about, key, "left").fillna(0)
    n = F.col
    fine = n("broken").isNull()
    issues = F.array(
        _issue("tracked_changes", "warning", n("tracked"), F.lit("holds tracked changes")),
        _issue("macros", "warning", n("packages") > 0, F.lit("holds macros or packages")),
        _issue("missing_properties", "info", fine & (n("created") == 0), F.lit("has no creation date")),
        _issue("broken_images", "warning", (n("drawings") > 0) & (n("images") == 0), F.format_string("%d drawings but no image", "drawings")),
        _issue("corruption", "error", ~fine, n("broken")),
    )
    return _judged(all_.select(key, issues.alias("issues")), key, by=("errors", "warnings"))


def slide_metrics(slides: DataFrame, key: str = "path") -> DataFrame:
    """Of each presentation: slides, hidden ones, those with notes, title (of the first slide that has one), words and characters."""
    said = F.concat_ws("\n", "text", "notes")
    return slides.where("problem IS NULL").groupBy(key).agg(
        F.count(F.lit(1)).alias("slides"), F.count(F.when(F.col("hidden"), 1)).alias("hidden_slides"), F.count("notes").alias("slides_with_notes"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("slide"))).alias("title"), F.sum(text.word_count(said)).alias("words"), F.sum(F.length(said)).alias("chars"),
    )


def slide_notes(slides: DataFrame, key: str = "path") -> DataFrame:
    """Slides with notes: slide, title, notes, and the number of all slides."""
    good = slides.where("problem IS NULL")
    return good.where("notes IS NOT NULL").join(good.groupBy(key).agg(F.count(F.lit(1)).alias("slides")), key).select(key, "slide", "title", "notes", "slides")


def searchable(kind: str, rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, place, text) of what a search over files reads: a paragraph, a slide with its notes, or a sheet's row."""
    good = rows.where("problem IS NULL")
    if kind == "docx":
        return good.select(key, F.col("paragraph").alias("place"), "text")
    if kind == "pptx":
        return good.select(key, F.col("slide").alias("place"), F.concat_ws("\n", "text", "notes").alias("text"))
    if kind == "xlsx":
        return good.where("row_index IS NOT NULL").select(key, (F.col("row_index") + 1).alias("place"), F.array_join("cells", "\n").alias("text"))
    raise ValueError(f"{kind!r} files aren't searched")


def search_office(kind: str, rows: DataFrame, key: str = "path", **how) -> DataFrame:
    """A row for each match in office files: key, place, match, start, end and context; how is as in spans.search."""
    hits = searchable(kind, rows, key).select(key, "place", F.explode(spans.search(F.col("text"), **how)).alias("m"))
    return hits.select(key, "place", "m.match", "m.start", "m.end", "m.context")


#: Characters of a match over the rows of a file, at most.
REACH = 10_000


def search_joined(rows: DataFrame, key: str = "path", query: str | None = None, pattern: str | None = None, context: int = 80, reach: int = REACH) -> DataFrame:
    """A row for each match in the text of each file, its rows (key, place, text) joined by line ends in order of place:
    key, place (of the row where the match begins), match, start, end and context, with offsets in the file. A match may
    go over rows, for as many characters as reach says; what is longer isn't found.

    A file passes through a task row by row; of its text no more is held than a few times the reach and its longest
    row. Arguments are checked as in spans.search; patterns are read by Python. Null texts are empty rows."""
    spans.search(F.lit(""), query=query, pattern=pattern, context=context)
    wanted = re.compile(re.escape(query), re.IGNORECASE) if pattern is None else re.compile(pattern)
    kinds = [rows.schema[c].dataType.simpleString() for c in (key, "place")]

    def found(texts):
        """Matches of one file's (place, text)."""
        held, base, at, rest = "", 0, 0, iter(texts)  # the text from offset base on; what is before at is done
        starts: list[int] = []
        places: list = []
        ended = False
        while not ended:
            size, more = len(held), []
            while size < len(held) + 3 * reach:
                row = next(rest, None)
                if row is None:
                    ended = True
                    break
                gap = "\n" if starts else ""
                starts.append(base + size + len(gap))
                places.append(row[0])
                more.append(gap + (row[1] or ""))
                size += len(more[-1])
            held = "".join([held, *more])
            sure = len(held) if ended else len(held) - reach  # a match that begins before it ends in held
            for m in wanted.finditer(held, at - base):
                if m.end() - m.start() > reach:
                    continue
                if m.start() >= sure:
                    break
                if not ended and m.end() + context > len(held):
                    sure = m.start()
                    break
                at = base + m.end()
                yield places[bisect_right(starts, base + m.start()) - 1], m[0], base + m.start(), at, held[max(0, m.start() - context) : m.end() + context]
            at = max(at, base + sure)
            cut = max(0, at - base - context - reach)
            gone = max(0, bisect_right(starts, base + cut) - 1)
            held, base = held[cut:], base + cut
            del starts[:gone], places[:gone]

    def run(batches):
        out = []
        for name, group in groupby((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)), key=lambda r: r[0]):
            for hit in found((r[1:] for r in group)):
                out.append((name, *hit))
                if len(out) >= 2000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    schema = f"`{key}` {kinds[0]}, place {kinds[1]}, match string, start long, end long, context string"
    types = to_arrow_schema(StructType.fromDDL(schema))
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
    return rows.select(key, "place", "text").repartition(key).sortWithinPartitions(key, "place").mapInArrow(run, schema)


def book_health(facts: DataFrame, key: str = "path") -> DataFrame:
    """Of each book's facts: issues (in order of check), their counts, and valid, which errors and problems spoil."""
    broken = F.when(F.col("problem").isNotNull(), F.struct(F.lit("corruption").alias("check"), F.lit("error").alias("severity"), F.col("problem.detail").alias("message")))
    own = F.when(F.col("kind").isin("error", "warning"), F.struct(F.col("name").alias("check"), F.col("kind").alias("severity"), F.col("value").alias("message")))
    per = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.coalesce(broken, own))).alias("issues"))
    return _judged(per, key, by=("errors",)).withColumnRenamed("healthy", "valid")


def book_metadata(facts: DataFrame, key: str = "path") -> DataFrame:
    """Of each book: title, authors, language, and every other element as a map of lists, all distinct values in order."""
    meta = facts.where("kind = 'metadata'").groupBy(key, "name").agg(F.array_sort(F.collect_set("value")).alias("values"))
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("values")[0]))
    known = ("title", "creator", "language")
    extra = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("name").isin(*known), F.struct("name", "values")))))
    return meta.groupBy(key).agg(one("title").alias("title"), F.max(F.when(F.col("name") == "creator", F.col("values"))).alias("authors"), one("language").alias("language"), extra.alias("extra"))


def with_front_matter(books: DataFrame, metadata: DataFrame, key: str = "path") -> DataFrame:
    """books(key, markdown, language) with the title as a heading and the authors in front, unless the text begins
    with that heading; the language that the metadata tells goes before the guess."""
    both = books.join(metadata.select(key, "title", "authors", F.col("language").alias("told")), key, "left")
    head = F.concat(F.lit("# "), "title")
    title = F.when(F.col("title").isNotNull() & ~F.startswith("markdown", head), head)
    authors = F.when(F.col("title").isNotNull() & (F.size("authors") > 0), F.concat(F.lit("*"), F.array_join("authors", ", "), F.lit("*")))
    front = F.concat_ws("\n\n", title, authors, F.when(F.col("markdown") != "", F.col("markdown")))
    return both.withColumns({"markdown": front, "language": F.coalesce("told", "language")}).drop("told", "title", "authors")


def outline(slides: DataFrame, key: str = "path") -> DataFrame:
    """Markdown of presentations: a heading for each slide, its other lines as items, notes as a quote."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & (F.trim(x) != F.coalesce(F.col("title"), F.lit(""))))
    part = F.concat_ws(
        "\n\n",
        F.concat(F.lit("## "), F.col("slide").cast("string"), F.lit(". "), F.coalesce("title", F.lit(""))),
        F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), F.trim(x))), "\n")),
        F.when(F.col("notes").isNotNull(), F.concat(F.lit("> **Notes:** "), F.regexp_replace("notes", "\n", " "))),
    )
    parts = F.array_sort(F.collect_list(F.struct("slide", part.alias("m"))))
    return slides.where("problem IS NULL").groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["m"]), "\n\n").alias("markdown"))


def book_text(chapters: DataFrame, key: str = "path") -> DataFrame:
    """Of each book: chapters, text (chapters that aren't blank, parted by a blank line), Markdown, words and language."""
    plain = chapters.where("problem IS NULL").select(key, "chapter", html.to_text(F.col("markup")).alias("t"), html.to_markdown(F.col("markup")).alias("m"))
    parts = F.array_sort(F.collect_list(F.struct("chapter", "t", "m")))
    joined = lambda f: F.array_join(F.filter(F.transform("parts", lambda p: p[f]), lambda x: x != ""), "\n\n")
    books = plain.groupBy(key).agg(parts.alias("parts")).select(key, F.size("parts").alias("chapters"), joined("t").alias("text"), joined("m").alias("markdown"))
    return books.withColumns({"words": text.word_count(F.col("text")), "language": text.language(F.col("text"))})
