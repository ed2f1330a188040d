"""Files as rows, and what lies in them as more rows.

Spark's binaryFile reader lists and reads the files; a size limit is pushed into it. Small helpers turn
one file's bytes into rows inside the tasks, and what is broken becomes a row's problem (status, title
and detail), so that one file never fails a job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of an archive: entries, inflated bytes of one, and how far it may inflate.
MOST_ENTRIES, MOST_INFLATED, MOST_RATIO = 8192, 64 << 20, 500


#: What a problem is: the status that a service would answer with, its title, and what happened.
PROBLEM = "struct<status:int,title:string,detail:string>"
#: Titles of statuses.
TITLES = {400: "Bad Request", 404: "Not Found", 408: "Request Timeout", 413: "Payload Too Large", 415: "Unsupported Media Type", 422: "Unprocessable Entity", 501: "Not Implemented"}


class Refused(ValueError):
    """Why a helper gives no rows, with the status it stands for."""

    def __init__(self, detail: str, status: int = 422) -> None:
        super().__init__(detail)
        self.status = status


def problem(status: int, detail: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(TITLES[status]).alias("title"), detail.alias("detail")).cast(PROBLEM)


def decode(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD and a byte-order mark stays."""
    return F.make_valid_utf8(content.cast("string"))


def scan(spark: SparkSession, path: str, most_bytes: int | None = None, glob: str | None = None) -> DataFrame:
    """path, file_name, ext, length, modified, content and problem of every file below path.

    Files of over most_bytes (none or less: no limit) are rows with a problem, whose content isn't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    about = ["path", name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), "length", F.col("modificationTime").alias("modified")]
    none = F.lit(None).cast(PROBLEM).alias("problem")
    if most_bytes is None or most_bytes <= 0:
        return files.select(*about, "content", none)
    said = problem(413, F.format_string("%d bytes are over the limit of %d", F.col("length"), F.lit(most_bytes))).alias("problem")
    small = files.where(F.col("length") <= most_bytes).select(*about, "content", none)
    return small.union(files.where(F.col("length") > most_bytes).select(*about, F.lit(None).cast("binary"), said))


def reassemble(chunks: DataFrame, file: str = "file_name", order: str = "seq", data: str = "data") -> DataFrame:
    """Files (file, content) put together from chunks in their order."""
    parts = F.array_sort(F.collect_list(F.struct(order, data)))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p[data])), ""))
    return chunks.groupBy(file).agg(parts.alias("parts")).select(file, joined.alias("content"))


def expand(files: DataFrame, helper: Callable[[bytes], Iterator[tuple]], schema: str, key: str = "path", content: str = "content") -> DataFrame:
    """Rows of every file: key, the helper's columns, and problem, null where all went well."""
    columns = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", schema)]
    kind = files.schema[key].dataType.simpleString()
    types = _arrow(f"{schema}, problem {PROBLEM}")

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one content at a time
                rows = []
                try:
                    for row in helper(raw.as_py() or b""):
                        rows.append((name, *row, None))
                        if len(rows) >= 5000:
                            yield _batch(rows, columns, types, key, batch.schema.field(0).type)
                            rows = []
                except Exception as broken:  # a broken file is a row, not a failed job
                    status = getattr(broken, "status", 422)
                    said = str(broken) if isinstance(broken, Refused) else f"{type(broken).__name__}: {broken}"
                    rows.append((name, *[None] * len(columns), {"status": status, "title": TITLES[status], "detail": said[:500]}))
                if rows:
                    yield _batch(rows, columns, types, key, batch.schema.field(0).type)

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, {schema}, problem {PROBLEM}")


def _arrow(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]


def _batch(rows, columns, types, key, key_type) -> pa.RecordBatch:
    data = list(zip(*rows, strict=True))
    arrays = [pa.array(c, t) for c, t in zip(data, [key_type, *types], strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [key, *columns, "problem"])


# ---- helpers: the rows of one file

ZIP_ENTRIES = "entry string, is_dir boolean, size long, packed long, method string, crc32 string, modified string"


def zip_entries(raw: bytes) -> Iterator[tuple]:
    """The central directory; nothing is inflated."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for e in archive.infolist():
            try:
                when = "{:04}-{:02}-{:02}T{:02}:{:02}:{:02}".format(*e.date_time) if e.date_time[1] and e.date_time[2] else None
            except (IndexError, ValueError):
                when = None
            yield e.filename, e.filename.endswith(("/", "\\")), e.file_size, e.compress_size, "deflated" if e.compress_size < e.file_size else "stored", f"{e.CRC:08x}", when


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """A part's tree, null if it is missing; document types and bombs are refused."""
    try:
        info = archive.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MOST_INFLATED or info.file_size > MOST_RATIO * max(info.compress_size, 1) + 4096:
        raise Refused(f"{name} inflates too far", 413)
    raw = archive.read(info)
    if b"<!DOCTYPE" in raw[:4096] and not name.endswith((".html", ".xhtml", ".htm")) or b"<!ENTITY" in raw:
        raise Refused(f"{name} declares a document type")
    return ElementTree.fromstring(raw)


def _open(raw: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(raw))
    if len(archive.infolist()) > MOST_ENTRIES:
        raise Refused(f"more than {MOST_ENTRIES} entries", 413)
    return archive


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [x for x in e.iter() if _local(x) == name] if e is not None else []


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    found = {}
    for r in _all(_xml(archive, f"{folder}/_rels/{name}.rels"), "Relationship"):
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        while "/../" in path:
            path = re.sub(r"[^/]+/\.\./", "", path, count=1)
        found[r.get("Id", "")] = path
    return found


SHEET_ROWS = "sheet string, position int, visibility string, row_index int, row_number int, hidden boolean, cells array<string>, formulas array<string>, places array<string>"


def sheet_rows(raw: bytes) -> Iterator[tuple]:
    """Rows of all sheets with the cells present, as stored; formulas are null where a cell has none. A sheet
    without rows is one row whose row_index is null."""
    with _open(raw) as archive:
        texts = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(_xml(archive, "xl/sharedStrings.xml"), "si")]
        parts = _related(archive, "xl/workbook.xml")
        sheets = _all(_xml(archive, "xl/workbook.xml"), "sheet")
        if not sheets:
            raise Refused("no sheets")
        for position, sheet in enumerate(sheets):
            tree, n = _xml(archive, parts.get(_attribute(sheet, "id") or "", "")), -1
            about = sheet.get("name"), position, sheet.get("state", "visible")
            for n, row in enumerate(_all(tree, "row")):
                cells, formulas, places = [], [], []
                for c in (x for x in row if _local(x) == "c"):
                    kind, v, f = c.get("t"), next(iter(_all(c, "v")), None), next(iter(_all(c, "f")), None)
                    value = (v.text or "") if v is not None else ""
                    if kind == "s" and value.isdigit():
                        value = texts[int(value)] if int(value) < len(texts) else ""
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in _all(c, "t"))
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    cells.append(value)
                    formulas.append(f.text if f is not None else None)
                    places.append(c.get("r"))
                yield *about, n, int(row.get("r") or n + 1), row.get("hidden") in ("1", "true"), cells, formulas, places
            if n < 0:
                yield *about, None, None, None, [], [], []


WORKBOOKS = "kind string, sheet string, name string, value string, count int"


def workbook_facts(raw: bytes) -> Iterator[tuple]:
    """What isn't a cell: kinds sheet, external, hyperlink, hidden_column, macros, defined_name and property."""
    with _open(raw) as archive:
        parts, book, names = _related(archive, "xl/workbook.xml"), _xml(archive, "xl/workbook.xml"), archive.namelist()
        for sheet in _all(book, "sheet"):
            part = parts.get(_attribute(sheet, "id") or "", "")
            tree, name = _xml(archive, part), sheet.get("name")
            yield "sheet", name, sheet.get("state", "visible"), None, 1
            targets = _targets(archive, part)
            for link in _all(tree, "hyperlink"):
                yield "hyperlink", name, link.get("ref", ""), targets.get(_attribute(link, "id") or "", link.get("location", "")), 1
            for column in _all(tree, "col"):
                if column.get("hidden") in ("1", "true"):
                    low = int(column.get("min", "0"))
                    high = int(column.get("max", low))
                    yield "hidden_column", name, f"{letters(low)}:{letters(high)}", None, high - low + 1
        for part in (x for x in names if re.fullmatch(r"xl/externalLinks/[^/]+\.xml", x)):
            for target in _targets(archive, part).values():
                yield "external", None, part, target, 1
        if any(x.endswith("vbaProject.bin") for x in names):
            yield "macros", None, "vbaProject.bin", None, 1
        for d in _all(book, "definedName"):
            yield "defined_name", None, d.get("name"), d.text, 1
        yield from (("property", None, k, v, 1) for k, v in _properties(archive))


def letters(n: int) -> str:
    """A column's name from its number, from 1; nothing below."""
    said = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        said = chr(65 + k) + said
    return said


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relations, as they are written."""
    folder, _, name = part.rpartition("/")
    return {r.get("Id", ""): r.get("Target", "") for r in _all(_xml(archive, f"{folder}/_rels/{name}.rels"), "Relationship")}


def _properties(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Core, application and custom properties of an office file."""
    for part in ("docProps/core.xml", "docProps/app.xml"):
        tree = _xml(archive, part)
        for e in tree if tree is not None else []:
            if (e.text or "").strip():
                yield _local(e), e.text.strip()
    for p in _all(_xml(archive, "docProps/custom.xml"), "property"):
        yield f"custom.{p.get('name')}", "".join(x.text or "" for x in p)


PROPERTIES = "name string, value string"


def properties(raw: bytes) -> Iterator[tuple]:
    with _open(raw) as archive:
        yield from _properties(archive)


SLIDES = "slide int, hidden boolean, title string, text string, notes string, shapes int, pictures int, tables int"


def slides(raw: bytes) -> Iterator[tuple]:
    """Slides in the presentation's order; the title's placeholder or else the first line is the title."""
    text_of = lambda shape: "\n".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(shape, "p"))
    with _open(raw) as archive:
        parts = _related(archive, "ppt/presentation.xml")
        for n, item in enumerate(_all(_xml(archive, "ppt/presentation.xml"), "sldId"), 1):
            part = parts.get(item.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", ""), "")
            tree = _xml(archive, part)
            if tree is None:
                continue
            shapes = _all(tree, "sp")
            kind = lambda s: next((_attribute(p, "type") for p in _all(s, "ph")), None)
            text = "\n".join(x for x in map(text_of, shapes) if x.strip())
            heading = next((text_of(s).strip() for s in shapes if kind(s) in ("title", "ctrTitle")), None) or text.split("\n")[0].strip() or None
            notes = next((_xml(archive, p) for p in _related(archive, part).values() if "notesSlide" in p), None)
            said = "\n".join(x for x in (text_of(s) for s in _all(notes, "sp") if kind(s) not in ("sldImg", "sldNum")) if x.strip())
            yield n, tree.get("show") == "0", heading, text, said or None, len(shapes), len(_all(tree, "pic")), len(_all(tree, "tbl"))


PARAGRAPHS = "paragraph int, style string, text string, markdown string, tracked boolean, drawings int"


def paragraphs(raw: bytes) -> Iterator[tuple]:
    """Paragraphs and rows of tables in their order: text, and Markdown with headings, bold and italic runs.
    A row of a table is one row of style Table, whose first one has the rule below it."""
    with _open(raw) as archive:
        tree = _xml(archive, "word/document.xml")
        body = next(iter(_all(tree, "body")), tree)
        if tree is None:
            raise Refused("no word/document.xml", 415)
        n = 0
        for e in body:
            for style, text, markdown in _blocks_of(e):
                n += 1
                yield n, style, text, markdown, bool(_all(e, "ins") or _all(e, "del")), len(_all(e, "drawing"))


def _blocks_of(e: ElementTree.Element) -> Iterator[tuple[str | None, str, str]]:
    if _local(e) == "p":
        style = next((_attribute(x, "val") for x in _all(e, "pStyle")), None)
        level = re.fullmatch(r"Heading([1-6])", style or "")
        runs = "".join(map(_run, _all(e, "r")))
        yield style, _said(e), "#" * int(level[1]) + " " + runs if level and runs else runs
    elif _local(e) == "tbl":
        for k, row in enumerate(x for x in e if _local(x) == "tr"):
            cells = ["\n".join(map(_said, _all(c, "p"))) for c in row if _local(c) == "tc"]
            line = "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
            yield "Table", "\t".join(cells), line if k else line + "\n|" + " --- |" * len(cells)
    elif _local(e) == "sdt":
        for inner in _all(e, "sdtContent"):
            for x in inner:
                yield from _blocks_of(x)


def _said(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in _all(e, "t"))


def _run(r: ElementTree.Element) -> str:
    said = _said(r)
    on = lambda name: any(_attribute(x, "val") not in ("0", "false") for p in r if _local(p) == "rPr" for x in p if _local(x) == name)
    marks = "**" * on("b") + "*" * on("i")
    return marks + said + marks[::-1] if said.strip() and marks else said


DOCUMENTS = "kind string, name string, value string"


def document_facts(raw: bytes) -> Iterator[tuple]:
    """What isn't a paragraph: kinds property, package (embedded), image, and count, of all paragraphs and tables
    wherever they are."""
    with _open(raw) as archive:
        if "word/document.xml" not in archive.namelist():
            raise Refused("no word/document.xml", 415)
        body = next(iter(_all(_xml(archive, "word/document.xml"), "body")), None)
        yield from (("count", name, str(len(_all(body, tag)))) for name, tag in (("paragraphs", "p"), ("tables", "tbl")))
        yield from (("property", k, v) for k, v in _properties(archive))
        for name in archive.namelist():
            if name.startswith("word/embeddings/") or name.endswith("vbaProject.bin"):
                yield "package", name, None
            elif name.startswith("word/media/"):
                yield "image", name, None


CHAPTERS = "chapter int, item string, markup string"


def chapters(raw: bytes) -> Iterator[tuple]:
    """An EPUB's spine, each item's markup; text and Markdown come from the functions over HTML."""
    with _open(raw) as archive:
        root = next(iter(_all(_xml(archive, "META-INF/container.xml"), "rootfile")), None)
        package = _xml(archive, root.get("full-path", "")) if root is not None else None
        if package is None:
            raise Refused("no package document")
        if "META-INF/encryption.xml" in archive.namelist():
            raise Refused("the book is encrypted")
        folder = root.get("full-path", "").rpartition("/")[0]
        items = {i.get("id"): i.get("href", "") for i in _all(package, "item")}
        for n, ref in enumerate(_all(package, "itemref"), 1):
            href = items.get(ref.get("idref"))
            if href is not None:
                name = f"{folder}/{href}".lstrip("/")
                info = archive.getinfo(name)
                if info.file_size > MOST_INFLATED:
                    raise Refused(f"{name} inflates too far", 413)
                yield n, name, archive.read(info).decode("utf-8", "replace")


BOOK_FACTS = "kind string, name string, value string"
#: Limits of a book: inflated bytes of all entries.
MOST_BOOK = 512 << 20


def book_facts(raw: bytes) -> Iterator[tuple]:
    """A book's check and metadata: kinds error and warning (name is the check), count, and metadata, one row
    for each distinct value of a Dublin Core element."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as broken:
        yield "error", "container", f"not a readable archive: {broken}"
        return
    with archive:
        entries = archive.infolist()
        wide = next((e for e in entries if e.compress_size and e.file_size // e.compress_size > MOST_RATIO), None)
        if len(entries) > MOST_ENTRIES:
            yield "error", "limits", f"{len(entries)} entries are more than {MOST_ENTRIES}"
            return
        if wide or sum(e.file_size for e in entries) > MOST_BOOK:
            yield "error", "limits", f"{wide.filename} inflates too far" if wide else f"inflates to over {MOST_BOOK} bytes"
            return
        yield "count", "entries", str(len(entries))
        yield from _mimetype(archive, entries)
        if "META-INF/encryption.xml" in archive.namelist():
            yield "error", "drm", "META-INF/encryption.xml: the content is encrypted"
        root = next(iter(_all(_xml(archive, "META-INF/container.xml"), "rootfile")), None)
        if root is None:
            yield "error", "container", "META-INF/container.xml names no package"
            return
        package = _xml(archive, root.get("full-path", ""))
        if package is None:
            yield "error", "package", f"{root.get('full-path')} is missing"
            return
        yield from _package_facts(archive, package, root.get("full-path", "").rpartition("/")[0])


def _mimetype(archive: zipfile.ZipFile, entries: list[zipfile.ZipInfo]) -> Iterator[tuple]:
    own = next((e for e in entries if e.filename == "mimetype"), None)
    if own is None:
        yield "error", "mimetype", "no mimetype entry"
        return
    declared = archive.read(own).decode("utf-8", "replace").strip() if own.file_size < 1000 else "too long"
    if declared != "application/epub+zip":
        yield "error", "mimetype", f"declares {declared!r}"
    if entries[0] is not own:
        yield "warning", "mimetype", "isn't the first entry"
    if own.compress_size != own.file_size:
        yield "warning", "mimetype", "is compressed"


def _package_facts(archive: zipfile.ZipFile, package: ElementTree.Element, folder: str) -> Iterator[tuple]:
    items = {i.get("id"): i.get("href", "") for i in _all(package, "item")}
    spine = [r.get("idref") for r in _all(package, "itemref")]
    yield "count", "manifest_items", str(len(items))
    yield "count", "spine_items", str(len(spine))
    if not spine:
        yield "error", "spine", "the spine is empty"
    names = set(archive.namelist())
    for ref in spine:
        if ref not in items:
            yield "error", "spine", f"{ref} isn't in the manifest"
    for href in items.values():
        if f"{folder}/{href.split('#')[0]}".lstrip("/") not in names:
            yield "warning", "manifest", f"{href} is missing"
    found = [(_local(e), (e.text or "").strip()) for m in _all(package, "metadata") for e in m if (e.text or "").strip() and _local(e) != "meta"]
    for name, value in dict.fromkeys(found):
        yield "metadata", name, value
    for name in ("title", "language"):
        if not any(n == name for n, _ in found):
            yield "warning", "metadata", f"no {name}"


MAILS = "subject string, sender string, recipients array<string>, sent string, body string, markup string, attachments array<struct<name:string,kind:string,size:bigint>>"


def mail(raw: bytes) -> Iterator[tuple]:
    """One row of a message: first text and first HTML part, attachments measured after decoding."""
    m = message_from_bytes(raw, policy=policy.default)
    body = markup = None
    attached = []
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), part.get_filename()
        data = part.get_payload(decode=True) or b""
        if name or part.get_content_disposition() == "attachment":
            attached.append({"name": name, "kind": kind, "size": len(data)})
        elif kind == "text/plain" and body is None:
            body = data.decode(part.get_content_charset() or "utf-8", "replace")
        elif kind == "text/html" and markup is None:
            markup = data.decode(part.get_content_charset() or "utf-8", "replace")
    to = [str(a) for h in ("to", "cc", "bcc") for v in m.get_all(h, []) for a in v.addresses]
    try:
        sent = parsedate_to_datetime(m["date"]).isoformat() if m["date"] else None
    except ValueError:
        sent = None
    yield m["subject"], m["from"], to, sent, body, markup, attached


DELIMITERS, SNIFFED_ROWS = ",;\t|", 50
LINES = "line int, delimiter string, cells array<string>"


def split_rows(text: str, delimiter: str, most: int | None = None) -> Iterator[list[str]]:
    """Rows of cells: a quote may open within a cell, doubled quotes are one, quoted line ends stay, and rows
    of one empty cell are left out."""
    outside = re.compile(f'[^"\r\n{re.escape(delimiter)}]+|"|\r\n|[\r\n]|{re.escape(delimiter)}')
    inside = re.compile('[^"]+|""|"')
    row, cell, quoted, given, at = [], [], False, 0, 0
    while at < len(text):
        t = (inside if quoted else outside).match(text, at)[0]
        at += len(t)
        if t == '"':
            quoted = not quoted
        elif quoted:
            cell.append('"' if t == '""' else t)
        elif t == delimiter:
            row.append("".join(cell))
            cell = []
        elif t[0] in "\r\n":
            row.append("".join(cell))
            if row != [""]:
                yield row
                given += 1
                if given == most:
                    return
            row, cell = [], []
        else:
            cell.append(t)
    row.append("".join(cell))
    if row != [""]:
        yield row


def sniff_delimiter(text: str) -> str:
    """The delimiter with the steadiest number of cells in the first rows; the earlier one on ties."""
    best, top = ",", -1.0
    for d in DELIMITERS:
        sizes = [len(r) for r in split_rows(text, d, SNIFFED_ROWS)]
        if sizes:
            usual = max(dict.fromkeys(sizes), key=sizes.count)
            score = 100 * sizes.count(usual) / len(sizes) + usual
            if usual > 1 and score > top:
                best, top = d, score
    return best


def delimited(raw: bytes) -> Iterator[tuple]:
    text = raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    d, n = sniff_delimiter(text), -1
    for n, row in enumerate(split_rows(text, d)):
        yield n, d, row
    if n < 0:
        raise Refused("the file holds no rows")


HELPERS = {
    "zip": (zip_entries, ZIP_ENTRIES),
    "xlsx": (sheet_rows, SHEET_ROWS),
    "xlsx facts": (workbook_facts, WORKBOOKS),
    "docx facts": (document_facts, DOCUMENTS),
    "epub facts": (book_facts, BOOK_FACTS),
    "properties": (properties, PROPERTIES),
    "pptx": (slides, SLIDES),
    "docx": (paragraphs, PARAGRAPHS),
    "epub": (chapters, CHAPTERS),
    "eml": (mail, MAILS),
    "csv": (delimited, LINES),
}


def contents(files: DataFrame, kind: str, key: str = "path", content: str = "content") -> DataFrame:
    """The rows that files of a kind hold, by the names in HELPERS."""
    helper, schema = HELPERS[kind]
    return expand(files, helper, schema, key, content)
