"""Queries over workbooks, presentations, documents and books, which are made from table rows as in plans.files."""

from __future__ import annotations

import io
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import content
from foliant.operators import office
from foliant.plans.files import CUSTOMERS, NATION_FILE, TURN_FILE, by_file, by_turns, packed, some_at_once
from foliant.plans.texts import _language as language_sql
from foliant.sources import files
from foliant.sources.tables import table

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zipped(parts: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return raw.getvalue()


def _made(rows: DataFrame, build) -> DataFrame:
    """(file, content): build's archive of each row (file, parts)."""

    def run(batches):
        for batch in some_at_once(batches):
            out = [_zipped(build(name, parts)) for name, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["file", "content"])

    return rows.mapInArrow(run, "file string, content binary")


def _related(*targets: str) -> str:
    return "<R>" + "".join(f'<Relationship Id="r{k}" Target="{t}"/>' for k, t in enumerate(targets)) + "</R>"


# ---- workbooks


def _workbook(name: str, rows: list[dict]) -> dict[str, str]:
    """Customers, a hidden sheet with a formula, and an empty sheet; in odd nations the formula reaches outside, and
    macros, a link and an external workbook are there."""
    odd = int(name.split("-")[0]) % 2
    row = lambda cells, more="": f"<row{more}>" + "".join(cells) + "</row>"
    body = [row(['<c t="s"><v>0</v></c>'])] + [row([f'<c t="inlineStr"><is><t>{r["c_name"]}</t></is></c>', "<c><v>1</v></c>"], ' hidden="1"' if r["c_custkey"] % 7 == 0 else "") for r in rows]
    formula = 'webservice("x")' if odd else "SUM(A1:A2)"
    sheet = lambda n, inside, more="": f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}">{more}<sheetData>{inside}</sheetData></worksheet>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="customers" r:id="r0"/><sheet name="links" state="hidden" r:id="r1"/><sheet name="none" r:id="r2"/></sheets>'
        '<definedNames><definedName name="all">customers!A:B</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": _related("worksheets/1.xml", "worksheets/2.xml", "worksheets/3.xml"),
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>na|me</t></si></sst>',
        "xl/worksheets/1.xml": sheet(1, "".join(body), '<cols><col min="27" max="28" hidden="1"/></cols>'),
        "xl/worksheets/2.xml": sheet(2, row([f'<c r="B2"><f>{formula}</f><v>0</v></c>'])),
        "xl/worksheets/3.xml": sheet(3, ""),
        "docProps/core.xml": f"<p><title>{name}</title></p>",
    }
    if odd:
        parts["xl/vbaProject.bin"] = "x"
        parts["xl/externalLinks/1.xml"] = "<e/>"
        parts["xl/externalLinks/_rels/1.xml.rels"] = _related("other.xlsx")
        parts["xl/worksheets/2.xml"] = parts["xl/worksheets/2.xml"].replace("</worksheet>", '<hyperlinks><hyperlink ref="A1" r:id="r0"/></hyperlinks></worksheet>')
        parts["xl/worksheets/_rels/2.xml.rels"] = _related("https://example.org/x")
    return parts


def _workbooks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    named = by_file(table(spark, sf, "customer"), F.concat_ws("-", "c_nationkey", F.floor(F.col("c_custkey") / CUSTOMERS).cast("string")))
    rows = named.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))
    made = _made(rows, _workbook)
    return files.contents(made, "xlsx", "file"), files.contents(made, "xlsx facts", "file")


_BOOKS = f"(SELECT {NATION_FILE} AS file, c_nationkey % 2 = 1 AS odd, count(*) AS n, count(*) FILTER (c_custkey % 7 = 0) AS h, sum(length(c_name)) AS l FROM customer GROUP BY ALL)"


def workbook_sheets(spark: SparkSession, sf: str) -> DataFrame:
    return office.sheets(_workbooks(spark, sf)[0], "file")


WORKBOOK_SHEETS = f"""
SELECT file, 'customers' AS sheet, 0::INT AS position, 'visible' AS visibility, n + 1 AS row_count, 2 * n + 1 AS cell_count, 0::BIGINT AS formula_count, 2::INT AS column_count FROM {_BOOKS}
UNION ALL SELECT file, 'links', 1, 'hidden', 1, 1, 1, 1 FROM {_BOOKS} UNION ALL SELECT file, 'none', 2, 'visible', 0, 0, 0, 0 FROM {_BOOKS}"""


def workbook_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return office.workbook_metrics(*_workbooks(spark, sf), "file")


WORKBOOK_METRICS = f"""SELECT file, 3::BIGINT AS sheets, 1::BIGINT AS hidden_sheets, 2::BIGINT AS visible_sheets, n + 2 AS rows, 2 * n + 2 AS cells, 1::BIGINT AS formulas,
1::BIGINT AS defined_names, 2 * n + 2 AS words, (l + n + 6)::BIGINT AS chars FROM {_BOOKS}"""


def workbook_health(spark: SparkSession, sf: str) -> DataFrame:
    told = office.workbook_health(*_workbooks(spark, sf), "file")
    return told.select("file", F.array_join(F.transform("issues", lambda i: i["check"]), ",").alias("issues"), "errors", "warnings", "infos", "healthy")


WORKBOOK_HEALTH = f"""SELECT file, CASE WHEN odd THEN 'macros,external_links,risky_formulas,' ELSE '' END || 'hidden_content' AS issues, 0::INT AS errors, (3 * odd::INT)::INT AS warnings, 1::INT AS infos, true AS healthy FROM {_BOOKS}"""


def workbook_hidden(spark: SparkSession, sf: str) -> DataFrame:
    found = office.hidden(*_workbooks(spark, sf), "file")
    return found.groupBy("file", "kind", "sheet").agg(F.sum("count").alias("hidden"), F.min("place").alias("first_place"))


WORKBOOK_HIDDEN = f"""
WITH r AS (SELECT {NATION_FILE} AS file, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_custkey // {CUSTOMERS} ORDER BY c_custkey) + 1 AS nr FROM customer)
SELECT file, 'row' AS kind, 'customers' AS sheet, count(*) AS hidden, min(nr::VARCHAR) AS first_place FROM r WHERE c_custkey % 7 = 0 GROUP BY file
UNION ALL SELECT file, 'sheet', 'links', 1, 'hidden' FROM {_BOOKS} UNION ALL SELECT file, 'column', 'customers', 2, 'AA:AB' FROM {_BOOKS}"""


def workbook_links(spark: SparkSession, sf: str) -> DataFrame:
    return office.link_audit(*_workbooks(spark, sf), "file")


WORKBOOK_LINKS = f"""SELECT file, kind, sheet, place, target FROM {_BOOKS}, (VALUES ('external', NULL, 'xl/externalLinks/1.xml', 'other.xlsx'), ('hyperlink', 'links', 'A1', 'https://example.org/x'),
('macros', NULL, 'vbaProject.bin', NULL), ('risky_formula', 'links', 'B2', 'WEBSERVICE: webservice("x")')) AS v(kind, sheet, place, target) WHERE odd"""


def workbook_properties(spark: SparkSession, sf: str) -> DataFrame:
    return _workbooks(spark, sf)[1].where("kind = 'property'").select("file", "name", "value")


WORKBOOK_PROPERTIES = f"SELECT file, 'title' AS name, file AS value FROM {_BOOKS}"


def sheet_read(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the sheet of customers, found by its name in another case, padded; and of one that no workbook has."""
    rows = _workbooks(spark, sf)[0]
    read = office.read_sheet(rows, "CUSTOMERS", 20, "file").union(office.read_sheet(rows, "gone", 20, "file"))
    return read.select("file", "row_index", F.array_join("cells", ",").alias("cells"), F.col("problem.status").alias("status"), F.col("problem.detail").alias("detail"))


SHEET_READ = f"""
WITH r AS (SELECT {NATION_FILE} AS file, c_name, (row_number() OVER (PARTITION BY c_nationkey, c_custkey // {CUSTOMERS} ORDER BY c_custkey))::INT AS row_index FROM customer)
SELECT file, row_index, c_name || ',1' AS cells, NULL::INT AS status, NULL AS detail FROM r WHERE row_index < 20 UNION ALL SELECT file, 0, 'na|me,', NULL, NULL FROM {_BOOKS}
UNION ALL SELECT file, NULL, NULL, 404, 'the sheets are: customers, links, none' FROM {_BOOKS}"""


def sheet_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return office.sheet_markdown(_workbooks(spark, sf)[0], "file").select("file", "sheet", "markdown")


SHEET_MARKDOWN = f"""
SELECT {NATION_FILE} AS file, 'customers' AS sheet, '## customers' || chr(10) || chr(10) || '| na\\|me |  |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_name || ' | 1 |', chr(10) ORDER BY c_custkey) AS markdown FROM customer GROUP BY 1
UNION ALL SELECT file, 'links', '## links' || chr(10) || chr(10) || '| 0 |' || chr(10) || '| --- |' FROM {_BOOKS} UNION ALL SELECT file, 'none', '## none' || chr(10) || chr(10) || '_(empty)_' FROM {_BOOKS}"""


def workbook_search(spark: SparkSession, sf: str) -> DataFrame:
    return office.search_office("xlsx", _workbooks(spark, sf)[0], "file", pattern=r"0[0-9]\n", context=3).select("file", "place", "match", "start", "end")


WORKBOOK_SEARCH = f"""
WITH r AS (SELECT {NATION_FILE} AS file, c_name, (row_number() OVER (PARTITION BY c_nationkey, c_custkey // {CUSTOMERS} ORDER BY c_custkey))::INT + 1 AS place FROM customer)
SELECT file, place, c_name[-2:] || chr(10) AS "match", (length(c_name) - 2)::INT AS "start", (length(c_name) + 1)::INT AS "end" FROM r WHERE c_name[-2] = '0' AND regexp_matches(c_name, '[0-9]$')"""


# ---- presentations


def _presentation(name: str, turns: list[dict]) -> dict[str, str]:
    """A slide for each turn, stored in reverse; notes on even turns, every fifth hidden."""
    shape = lambda t, kind="": f'<sp><nvPr>{f"<ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</nvPr><p><r><t>{t}</t></r></p></sp>'
    count = len(turns)
    parts = {
        "ppt/presentation.xml": f'<p xmlns:r="{REL}"><sldIdLst>' + "".join(f'<sldId r:id="r{count - 1 - k}"/>' for k in range(count)) + "</sldIdLst></p>",
        "ppt/_rels/presentation.xml.rels": _related(*(f"slides/{count - 1 - k}.xml" for k in range(count))),
    }
    for k, t in enumerate(turns):
        hidden = ' show="0"' if t["turn"] % 5 == 4 else ""
        parts[f"ppt/slides/{k}.xml"] = f"<sld{hidden}>{shape('turn ' + str(t['turn']))}{shape(t['role'], 'title')}</sld>"
        if t["turn"] % 2 == 0:
            parts[f"ppt/slides/_rels/{k}.xml.rels"] = _related(f"../notesSlides/{k}.xml")
            parts[f"ppt/notesSlides/{k}.xml"] = f"<n>{shape('said ' + t['role'])}{shape('img', 'sldImg')}</n>"
    return parts


def _slides(spark: SparkSession, sf: str) -> DataFrame:
    return files.contents(_made(by_turns(spark, sf, "role"), _presentation), "pptx", "file")


_SLIDES = f"(SELECT {TURN_FILE} AS file, turn, role, (row_number() OVER (PARTITION BY conv_id, turn // 200 ORDER BY turn))::INT AS slide FROM conversations)"


def slide_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return office.slide_metrics(_slides(spark, sf), "file")


SLIDE_METRICS = f"""SELECT file, count(*) AS slides, count(*) FILTER (turn % 5 = 4) AS hidden_slides, count(*) FILTER (turn % 2 = 0) AS slides_with_notes, arg_min(role, slide) AS title,
sum(CASE WHEN turn % 2 = 0 THEN 5 ELSE 3 END)::BIGINT AS words, sum(length('turn ' || turn) + 1 + length(role) + CASE WHEN turn % 2 = 0 THEN 6 + length(role) ELSE 0 END)::BIGINT AS chars FROM {_SLIDES} GROUP BY file"""


def slide_outline(spark: SparkSession, sf: str) -> DataFrame:
    return office.outline(_slides(spark, sf), "file")


SLIDE_OUTLINE = f"""SELECT file, string_agg('## ' || slide || '. ' || role || chr(10) || chr(10) || '- turn ' || turn || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '> **Notes:** said ' || role ELSE '' END, chr(10) || chr(10) ORDER BY slide) AS markdown
FROM {_SLIDES} GROUP BY file"""


def slide_notes(spark: SparkSession, sf: str) -> DataFrame:
    return office.slide_notes(_slides(spark, sf), "file")


SLIDE_NOTES = f"SELECT file, slide, role AS title, 'said ' || role AS notes, n AS slides FROM (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM {_SLIDES}) WHERE turn % 2 = 0"


def slide_search(spark: SparkSession, sf: str) -> DataFrame:
    return office.search_office("pptx", _slides(spark, sf), "file", query="SAID", context=2)


SLIDE_SEARCH = f"""
WITH s AS (SELECT file, slide, 'turn ' || turn || chr(10) || role || chr(10) || 'said ' || role AS t, length('turn ' || turn || chr(10) || role) + 1 AS pos FROM {_SLIDES} WHERE turn % 2 = 0)
SELECT file, slide AS place, 'said' AS "match", pos::INT AS "start", (pos + 4)::INT AS "end", substring(t, pos - 1, 8) AS context FROM s"""


# ---- documents


def _document(name: str, turns: list[dict]) -> dict[str, str]:
    """A heading, a paragraph with bold and italic runs for each turn, a table; in files of an odd conversation a
    tracked change, a package and a drawing without an image."""
    odd = int(name.split("-")[0]) % 2
    run = lambda t, *on: "<w:r>" + (f"<w:rPr>{''.join(f'<w:{x}/>' for x in on)}</w:rPr>" if on else "") + f"<w:t>{t}</w:t></w:r>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run(name)}</w:p>'
    for t in turns:
        body += "<w:p>" + run("turn ") + run(str(t["turn"]), "b") + run(" by ") + run(t["role"], "b", "i") + "</w:p>"
    cell = lambda t: f"<w:tc><w:p>{run(t)}</w:p></w:tc>"
    body += f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    parts = {"docProps/app.xml": f"<p><Pages>{len(turns)}</Pages></p>"}
    if odd:
        body += f"<w:p><w:ins>{run('new')}</w:ins><w:drawing/></w:p>"
        parts["word/embeddings/x.xlsx"] = "x"
    else:
        parts["docProps/core.xml"] = "<p><created>2024-01-01</created></p>"
    return parts | {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'}


def _documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    made = _made(by_turns(spark, sf, "role"), _document)
    return files.contents(made, "docx", "file"), files.contents(made, "docx facts", "file")


_DOCS = f"(SELECT {TURN_FILE} AS file, conv_id % 2 = 1 AS odd, count(*) AS n, sum(length('turn ' || turn || ' by ' || role)) AS l, string_agg('turn **' || turn || '** by ***' || role || '***', chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY ALL)"


def document_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return office.document_metrics(*_documents(spark, sf), "file")


DOCUMENT_METRICS = f"""SELECT file, n + 3 + odd::INT AS paragraphs, 1::BIGINT AS headings, 2::BIGINT AS table_rows, 4 * n + 5 + odd::INT AS words, (l + length(file) + 8 + 3 * odd::INT)::BIGINT AS chars, n::INT AS pages FROM {_DOCS}"""


def _letter(name: str, turns: list[dict]) -> dict[str, str]:
    """The turns' own texts as paragraphs, those with even numbers in a table of one cell, and an image in every third file."""
    run = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    said = [run(t["text"] or "") for t in turns]
    body = "".join(f"<w:tbl><w:tr><w:tc>{x}</w:tc></w:tr></w:tbl>" if t["turn"] % 2 == 0 else x for x, t in zip(said, turns, strict=True))
    parts = {"docProps/core.xml": f"<p><created>2024-01-0{1 + len(turns) % 9}</created><modified>{name}</modified></p>", "word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'}
    return parts | ({"word/media/image1.png": "x"} if int(name.split("-")[0]) % 3 == 0 else {})


def document_details(spark: SparkSession, sf: str) -> DataFrame:
    """What documents of whole turns hold, and in which language."""
    made = _made(by_turns(spark, sf, "text"), _letter)
    return office.document_details(files.contents(made, "docx", "file"), files.contents(made, "docx facts", "file"), "file")


DOCUMENT_DETAILS = f"""
WITH t AS (SELECT {TURN_FILE} AS file, conv_id, count(*) AS n, count(*) FILTER (turn % 2 = 0) AS tables, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL)
SELECT file, n AS all_paragraphs, tables, (conv_id % 3 = 0)::BIGINT AS images, {language_sql("text")} AS language, '2024-01-0' || (1 + n % 9) AS created, file AS modified FROM t"""


def document_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return office.document_markdown(_documents(spark, sf)[0], "file")


DOCUMENT_MARKDOWN = f"""SELECT file, '## ' || file || chr(10) || chr(10) || t || chr(10) || chr(10) || '| a\\|b | c |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || CASE WHEN odd THEN chr(10) || chr(10) || 'new' ELSE '' END AS markdown FROM {_DOCS}"""


def document_health(spark: SparkSession, sf: str) -> DataFrame:
    told = office.document_health(*_documents(spark, sf), "file")
    return told.select("file", F.array_join(F.transform("issues", lambda i: i["check"]), ",").alias("issues"), "errors", "warnings", "infos", "healthy")


DOCUMENT_HEALTH = f"""SELECT file, CASE WHEN odd THEN 'tracked_changes,macros,missing_properties,broken_images' ELSE '' END AS issues, 0::INT AS errors, (3 * odd::INT)::INT AS warnings, odd::INT AS infos, NOT odd AS healthy FROM {_DOCS}"""


def document_search(spark: SparkSession, sf: str) -> DataFrame:
    return office.search_office("docx", _documents(spark, sf)[0], "file", query="turn 1", context=4)


DOCUMENT_SEARCH = f"""
WITH t AS (SELECT {TURN_FILE} AS file, turn, 'turn ' || turn || ' by ' || role AS t, (row_number() OVER (PARTITION BY conv_id, turn // 200 ORDER BY turn))::INT + 1 AS place FROM conversations)
SELECT file, place, 'turn 1' AS "match", 0::INT AS "start", 6::INT AS "end", t[1:10] AS context FROM t WHERE starts_with(t, 'turn 1')"""


# ---- books


def _book(name: str, turns: list[dict]) -> dict[str, str]:
    """A chapter for each turn; files of an odd conversation have no language, and their mimetype comes last."""
    odd = int(name.split("-")[0]) % 2
    item = "".join(f'<item id="i{k}" href="{k}.xhtml"/>' for k in range(len(turns)))
    spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(turns)))
    about = f'<dc:title>Talk {name}</dc:title><dc:creator>B</dc:creator><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:subject>s</dc:subject>{"" if odd else "<dc:language>en</dc:language>"}'
    parts = {
        "META-INF/container.xml": '<c><rootfile full-path="b.opf"/></c>',
        "b.opf": f'<package xmlns:dc="dc"><metadata>{about}</metadata><manifest>{item}</manifest><spine>{spine}</spine></package>',
    }
    for k, t in enumerate(turns):
        parts[f"{k}.xhtml"] = f"<html><head><title>x</title></head><body><h2>{t['role']}</h2><p>turn <b>{t['turn']}</b></p></body></html>"
    mark = {"mimetype": "application/epub+zip"}
    return parts | mark if odd else mark | parts


def _epubs(spark: SparkSession, sf: str) -> DataFrame:
    return _made(by_turns(spark, sf, "role"), _book)


def book_text(spark: SparkSession, sf: str) -> DataFrame:
    """Books with their titles and authors in front."""
    made = _epubs(spark, sf)
    told = office.book_text(files.contents(made, "epub", "file"), "file")
    return office.with_front_matter(told, office.book_metadata(files.contents(made, "epub facts", "file"), "file"), "file").select("file", "chapters", "text", "markdown", "words", "language")


BOOK_TEXT = f"""SELECT {TURN_FILE} AS file, count(*)::INT AS chapters, string_agg(role || chr(10) || chr(10) || 'turn ' || turn, chr(10) || chr(10) ORDER BY turn) AS text,
'# Talk ' || {TURN_FILE} || chr(10) || chr(10) || '*A, B*' || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || 'turn **' || turn || '**', chr(10) || chr(10) ORDER BY turn) AS markdown,
(3 * count(*))::INT AS words, CASE WHEN conv_id % 2 = 0 THEN 'en' END AS language FROM conversations GROUP BY 1, conv_id"""


def book_health(spark: SparkSession, sf: str) -> DataFrame:
    told = office.book_health(files.contents(_epubs(spark, sf), "epub facts", "file"), "file")
    return told.select("file", F.array_join(F.transform("issues", lambda i: F.concat(i["check"], F.lit(": "), i["message"])), "; ").alias("issues"), "errors", "warnings", "valid")


BOOK_HEALTH = f"""SELECT DISTINCT {TURN_FILE} AS file, CASE WHEN conv_id % 2 = 1 THEN 'metadata: no language; mimetype: isn''t the first entry' ELSE '' END AS issues, 0::INT AS errors, (2 * (conv_id % 2))::INT AS warnings, true AS valid FROM conversations"""


def book_metadata(spark: SparkSession, sf: str) -> DataFrame:
    told = office.book_metadata(files.contents(_epubs(spark, sf), "epub facts", "file"), "file")
    return told.select("file", "title", F.array_join("authors", ",").alias("authors"), "language", F.to_json("extra").alias("extra"))


BOOK_METADATA = f"""SELECT DISTINCT {TURN_FILE} AS file, 'Talk ' || {TURN_FILE} AS title, 'A,B' AS authors, CASE WHEN conv_id % 2 = 0 THEN 'en' END AS language, '{{"subject":["s"]}}' AS extra FROM conversations"""


# ---- what is refused


def file_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of turns, or bare turns, read as files of every kind, and what is said of them."""
    kinds = ("xlsx", "pptx", "docx", "epub", "zip", "docx")
    made = by_turns(spark, sf, "text")
    bare = made.select("file", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").cast("binary").alias("content"))
    archives = made.mapInArrow(packed, "file string, content binary")
    kind = lambda k: F.split("file", "-")[0].cast("long") % 6 == k
    parts = [files.contents((bare if k == 5 else archives).where(kind(k)), name, "file").select("file", F.lit(name).alias("read_as"), "problem") for k, name in enumerate(kinds)]
    every = reduce(DataFrame.union, parts).distinct()
    return every.groupBy("read_as", "problem.status", "problem.title").agg(F.count(F.lit(1)).alias("files"))


FILE_PROBLEMS = f"""
WITH c AS (SELECT conv_id % 6 AS k, count(DISTINCT {TURN_FILE}) AS n FROM conversations GROUP BY 1)
SELECT read_as, status::INT AS status, title, n AS files FROM c JOIN (VALUES (0, 'xlsx', 422, 'Unprocessable Entity'), (2, 'docx', 415, 'Unsupported Media Type'), (3, 'epub', 422, 'Unprocessable Entity'),
  (4, 'zip', NULL, NULL), (5, 'docx', 422, 'Unprocessable Entity')) AS v(k, read_as, status, title) USING (k)"""


def conversion_support(spark: SparkSession, sf: str) -> DataFrame:
    """Documents behind the head of a book, a PDF or an archive, named by turns as one of them: whether they are converted, and why not."""
    name = F.concat(F.lit("f."), F.element_at(F.array(*[F.lit(x) for x in ("epub", "pdf", "docx", "txt")]), (F.col("doc_id") % 4 + 1).cast("int")))
    head = F.unhex(F.element_at(F.array(F.lit(("PK\3\4" + "\0" * 26 + "mimetypeapplication/epub+zip").encode().hex()), F.lit(b"%PDF-1.7".hex()), F.lit("504B030400000000")), (F.col("doc_id") % 3 + 1).cast("int")))
    rows = table(spark, sf, "documents").select(content.detection(name, F.concat(head, F.coalesce("text", F.lit("")).cast("binary"))).alias("d"))
    return rows.groupBy("d.detected", "d.declared", "d.mismatch", "d.supported", "d.problem.status", "d.problem.detail").agg(F.count(F.lit(1)).alias("files"))


CONVERSION_SUPPORT = """
WITH d AS (SELECT ['epub', 'pdf', 'zip'][doc_id % 3 + 1] AS detected, ['epub', 'pdf', 'docx', 'unknown'][doc_id % 4 + 1] AS declared FROM documents),
n AS (SELECT k, said, hint FROM (VALUES ('epub', 'EPUB', NULL), ('pdf', 'PDF', 'Use the PDF operations.'), ('docx', 'Word', NULL), ('zip', 'a ZIP archive', 'Use the archive inspection.')) AS v(k, said, hint)),
m AS (SELECT detected, declared, declared <> 'unknown' AND detected <> declared AS mismatch, a.said AS is_, a.hint, b.said AS says FROM d JOIN n a ON detected = a.k LEFT JOIN n b ON declared = b.k)
SELECT detected, declared, mismatch, detected = 'epub' AS supported, CASE WHEN detected <> 'epub' THEN 415::INT END AS status,
  CASE WHEN detected <> 'epub' THEN concat_ws(' ', 'The file is ' || is_ || '.', CASE WHEN mismatch THEN 'Its name says ' || says || '.' END, hint) END AS detail, count(*) AS files FROM m GROUP BY ALL"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (workbook_sheets, WORKBOOK_SHEETS), (workbook_metrics, WORKBOOK_METRICS), (workbook_health, WORKBOOK_HEALTH), (workbook_hidden, WORKBOOK_HIDDEN), (workbook_links, WORKBOOK_LINKS),
        (workbook_properties, WORKBOOK_PROPERTIES), (sheet_read, SHEET_READ), (sheet_markdown, SHEET_MARKDOWN), (workbook_search, WORKBOOK_SEARCH), (slide_metrics, SLIDE_METRICS), (slide_outline, SLIDE_OUTLINE),
        (slide_notes, SLIDE_NOTES), (slide_search, SLIDE_SEARCH), (document_metrics, DOCUMENT_METRICS), (document_details, DOCUMENT_DETAILS), (document_markdown, DOCUMENT_MARKDOWN), (document_health, DOCUMENT_HEALTH),
        (document_search, DOCUMENT_SEARCH), (book_text, BOOK_TEXT), (book_health, BOOK_HEALTH), (book_metadata, BOOK_METADATA), (file_problems, FILE_PROBLEMS), (conversion_support, CONVERSION_SUPPORT),
    )
}
