"""Bytes and what they stand for: hashes, encodings, control characters, transliteration, file formats."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Most bytes that encoding checks take.
MOST_BYTES = 256 << 20
#: Names of control bytes.
CONTROL_NAMES = {
    0x00: "NUL", 0x01: "SOH", 0x02: "STX", 0x03: "ETX", 0x04: "EOT", 0x05: "ENQ", 0x06: "ACK", 0x07: "BEL", 0x08: "BS",
    0x0B: "VT", 0x0C: "FF", 0x0E: "SO", 0x0F: "SI", 0x10: "DLE", 0x11: "DC1", 0x12: "DC2", 0x13: "DC3", 0x14: "DC4",
    0x15: "NAK", 0x16: "SYN", 0x17: "ETB", 0x18: "CAN", 0x19: "EM", 0x1A: "SUB", 0x1B: "ESC", 0x1C: "FS", 0x1D: "GS",
    0x1E: "RS", 0x1F: "US", 0x7F: "DEL",
}
#: Extensions of formats.
EXTENSIONS = {
    "epub": "epub", "mobi": "mobi", "azw": "mobi", "azw3": "mobi", "prc": "mobi", "pdb": "palmdoc", "djvu": "djvu",
    "djv": "djvu", "doc": "doc", "docx": "docx", "pdf": "pdf", "rtf": "rtf", "zip": "zip",
}


def hashes(content: Column) -> Column:
    return F.struct(F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.sha1(content).alias("sha1"))


def composite_hash(name: Column, content: Column) -> Column:
    """sha256 over "name:length:" and the bytes."""
    head = F.concat(name, F.lit(":"), F.octet_length(content).cast("string"), F.lit(":")).cast("binary")
    return F.sha2(F.concat(head, content), 256)


def media_type(content: Column) -> Column:
    """Of an image, by its leading bytes."""
    return (
        F.when(_starts(content, 0x89, 0x50, 0x4E, 0x47), "image/png")
        .when(_starts(content, 0xFF, 0xD8, 0xFF), "image/jpeg")
        .when(_starts(content, 0x47, 0x49, 0x46, 0x38), "image/gif")
        .when(_starts(content, 0x42, 0x4D), "image/bmp")
        .when(_starts(content, 0x49, 0x49, 0x2A, 0) | _starts(content, 0x4D, 0x4D, 0, 0x2A), "image/tiff")
        .when(_starts(content, 0x52, 0x49, 0x46, 0x46) & (F.substring(content, 9, 4).cast("string") == "WEBP"), "image/webp")
        .otherwise("application/octet-stream")
    )


def data_uri(content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(content), F.lit(";base64,"), F.base64(content))


def _starts(content: Column, *raw: int) -> Column:
    return F.hex(F.substring(content, 1, len(raw))) == "".join(f"{x:02X}" for x in raw)


def encoding(content: Column) -> Column:
    """struct(encoding, confidence, has_bom): a byte-order mark is certain, then ASCII, then valid UTF-8."""
    marks = (("utf-8", (0xEF, 0xBB, 0xBF)), ("utf-32le", (0xFF, 0xFE, 0, 0)), ("utf-32be", (0, 0, 0xFE, 0xFF)), ("utf-16le", (0xFF, 0xFE)), ("utf-16be", (0xFE, 0xFF)))
    valid = F.is_valid_utf8(content.cast("string"))
    ascii_ = F.octet_length(content) == F.length(content.cast("string"))
    name, sure, bom = F.when(valid & ascii_, "us-ascii").when(valid, "utf-8").otherwise("unknown"), F.when(valid & ascii_, "certain").when(valid, "high").otherwise("low"), F.lit(False)
    for label, raw in reversed(marks):
        here = _starts(content, *raw)
        name, sure, bom = F.when(here, label).otherwise(name), F.when(here, "certain").otherwise(sure), F.when(here, True).otherwise(bom)
    return F.struct(name.alias("encoding"), sure.alias("confidence"), bom.alias("has_bom"))


def normalise(text: Column, ending: str = "lf", strip_bom: bool = True, strip_controls: bool = False) -> Column:
    """Line endings lf (unix), crlf (windows), cr (mac) or keep; an unknown name raises."""
    targets = {"lf": "\n", "unix": "\n", "crlf": "\r\n", "windows": "\r\n", "cr": "\r", "mac": "\r", "keep": None}
    if ending not in targets:
        raise ValueError(f"unknown line ending {ending!r}")
    out = F.regexp_replace(text, "^﻿", "") if strip_bom else text
    if strip_controls:
        out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")
    if targets[ending] is not None:
        out = F.regexp_replace(F.regexp_replace(out, "\r\n?", "\n"), "\n", targets[ending])
    return out


def control_census(text: Column) -> Column:
    """Array of structs (code, name, offset, line, col, occurrences) of the control characters but tab and
    line ends, at most 32 kinds, in order of first offset; lines and columns from 1. Offsets and columns count bytes of
    UTF-8, and a CR is in no column."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\x00-\x08\x0B\x0C\x0E-\x1F\x7F])"), F.lit(1)))
    names = F.create_map(*[F.lit(x) for pair in CONTROL_NAMES.items() for x in pair])

    def told(c):
        at = F.position(c, text)
        before = F.substring(text, F.lit(1), at - 1)
        code = F.ascii(c)
        return F.struct(
            code.alias("code"),
            F.element_at(names, code).alias("name"),
            F.octet_length(before).alias("offset"),
            (F.size(F.split(before, "\n"))).alias("line"),
            (F.octet_length(F.replace(F.element_at(F.split(before, "\n"), -1), F.lit("\r"), F.lit(""))) + 1).alias("col"),
            (F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("occurrences"),
        )

    return F.slice(F.transform(found, told), 1, 32)


def sniff(content: Column) -> Column:
    """The format that the leading bytes tell; under eight bytes it is unknown."""
    text = lambda at, n: F.substring(content, at + 1, n).cast("string")
    zip_ = (
        F.when((text(30, 8) == "mimetype") & (text(38, 20) == "application/epub+zip"), "epub")
        .when(F.position(F.hex(F.lit("META-INF/container.xml").cast("binary")), F.hex(content)) > 0, "epub")
        .when(F.position(F.hex(F.lit("word/document.xml").cast("binary")), F.hex(content)) > 0, "docx")
        .otherwise("zip")
    )
    return (
        F.when(F.octet_length(content) < 8, "unknown")
        .when(_starts(content, 0xD0, 0xCF, 0x11, 0xE0, 0xA1, 0xB1, 0x1A, 0xE1), "ole2")
        .when(text(0, 5) == "%PDF-", "pdf")
        .when(text(0, 5) == "{\\rtf", "rtf")
        .when((text(0, 8) == "AT&TFORM") & text(12, 4).isin("DJVU", "DJVM", "DJVI"), "djvu")
        .when(_starts(content, 0x50, 0x4B, 3, 4), zip_)
        .when((F.octet_length(content) >= 78) & (text(60, 8) == "BOOKMOBI"), "mobi")
        .when((F.octet_length(content) >= 78) & (text(60, 8) == "TEXtREAd"), "palmdoc")
        .otherwise("unknown")
    )


def declared_format(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))), F.lit("unknown"))


def is_mismatch(detected: Column, declared: Column) -> Column:
    """Formats that differ, unless one is unknown or both are of the Palm family."""
    palm = ("mobi", "palmdoc")
    known = (detected != "unknown") & (declared != "unknown")
    return known & (detected != declared) & ~(detected.isin(*palm) & declared.isin(*palm))


#: What each format is called, which ones are converted, and where others belong.
NAMES = {"epub": "EPUB", "mobi": "MOBI", "palmdoc": "PalmDOC", "djvu": "DjVu", "doc": "Word 97-2003", "docx": "Word", "pdf": "PDF", "rtf": "RTF", "zip": "a ZIP archive", "ole2": "an OLE2 file", "unknown": "of an unknown format"}
CONVERTED = ("epub", "mobi", "palmdoc", "djvu", "ole2")
ELSEWHERE = {"pdf": "Use the PDF operations.", "docx": "Use the Word operations.", "zip": "Use the archive inspection."}


def detection(name: Column, content: Column) -> Column:
    """struct(detected, declared, mismatch, supported, problem): what a file is, and why it isn't converted if so."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    hints = F.create_map(*[F.lit(x) for pair in ELSEWHERE.items() for x in pair])

    def told(kinds: Column) -> Column:
        wrong = is_mismatch(kinds["detected"], kinds["declared"])
        detail = F.concat_ws(
            " ",
            F.concat(F.lit("The file is "), F.element_at(names, kinds["detected"]), F.lit(".")),
            F.when(wrong, F.concat(F.lit("Its name says "), F.element_at(names, kinds["declared"]), F.lit("."))),
            F.try_element_at(hints, kinds["detected"]),
        )
        fits = kinds["detected"].isin(*CONVERTED)
        refused = F.when(~fits, F.struct(F.lit(415).alias("status"), F.lit("Unsupported Media Type").alias("title"), detail.alias("detail")))
        return F.struct(kinds["detected"].alias("detected"), kinds["declared"].alias("declared"), wrong.alias("mismatch"), fits.alias("supported"), refused.alias("problem"))

    return F.element_at(F.transform(F.array(F.struct(sniff(content).alias("detected"), declared_format(name).alias("declared"))), told), 1)


#: Spellings of characters that code page 1252 hasn't got.
SPELLINGS = {
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2015": "--", "\u2032": "'", "\u2033": '"', "\u2035": "'", "\u2044": "/", "\u2212": "-",
    "\u2248": "~", "\u2260": "!=", "\u2264": "<=", "\u2265": ">=", "\u2190": "<-", "\u2192": "->", "\u2194": "<->",
    "\u2007": " ", "\u2008": " ", "\u2009": " ", "\u202f": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
    "\u25aa": "-", "\u25cb": "-", "\u25cf": "-",
}


def _in_1252(c: str) -> bool:
    if c in "\n\t" or " " <= c <= "~" or "\xa0" <= c <= "\xff":
        return True
    try:
        return ord(c) > 255 and len(c.encode("cp1252")) == 1
    except UnicodeEncodeError:
        return False


def spelled(text: str) -> str:
    """A text in the characters of code page 1252: other characters by their spelling, without their accents, or as "?"."""
    changed = {}
    for c in set(text):
        if not _in_1252(c):
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn" and _in_1252(x))
            changed[ord(c)] = SPELLINGS.get(c, bare or "?" * (1 + (ord(c) > 0xFFFF)))
    return text.translate(changed) if changed else text


def transliterate(text: Column) -> Column:
    """spelled in Arrow batches, since normal forms aren't a function of Spark; texts of those characters alone stay in the JVM."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else spelled(x) for x in texts.to_pylist()], pa.string())

    return F.coalesce(run(text), F.lit(""))
