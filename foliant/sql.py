"""The library in SQL: table functions over the contents of files, and functions over texts.

SELECT f.path, r.* FROM files f, LATERAL csv_lines(f.content) r. A filter on files belongs below the lateral join, since
Spark leaves it above a Python table function; the functions that take a name (a sheet, an entry) read no other one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from foliant.operators.profile import INTEGER, NUMBER
from foliant.sources.files import HELPERS, PROBLEM, TITLES, Refused

#: Names of table functions and the kinds of files that they read; those of CHOSEN take a second argument, the value of
#: their first column that is wanted (null: all).
TABLES = {"csv_lines": "csv", "sheet_rows": "xlsx", "slides": "pptx", "paragraphs": "docx", "chapters": "epub", "archive_entries": "zip", "mail_parts": "eml"}
CHOSEN = ("sheet_rows", "archive_entries")
#: Functions over texts, in the terms of SQL itself, so that they are optimised like any other expression.
SCALARS = {
    "is_number": ("v STRING", "BOOLEAN", f"v RLIKE r'{NUMBER}' AND v RLIKE '[0-9]'"),
    "is_integer": ("v STRING", "BOOLEAN", f"v RLIKE r'{INTEGER}'"),
    "share_secret": ("token STRING, password STRING", "STRING", "sha2(concat_ws(':', token, password), 256)"),
    "collapsed": ("t STRING", "STRING", r"regexp_replace(coalesce(t, ''), r'[\x20\x09-\x0D]+', ' ')"),
}


def table_function(kind: str, chosen: bool = False):
    """A table function with the rows that HELPERS gives for a kind of file, and problem, null where all went well."""
    helper, schema = HELPERS[kind]
    width = len(StructType.fromDDL(schema).fields)

    class Rows:
        def eval(self, content: bytes, wanted: str | None = None) -> Iterator[tuple]:
            try:
                for row in helper(content or b""):
                    if not chosen or wanted is None or row[0] == wanted:
                        yield (*row, None)
            except Exception as broken:  # a broken file is a row, not a failed query
                status = getattr(broken, "status", 422)
                said = str(broken) if isinstance(broken, Refused) else f"{type(broken).__name__}: {broken}"
                yield (*[None] * width, (status, TITLES[status], said[:500]))

    return udtf(Rows, returnType=f"{schema}, problem {PROBLEM}")


def register(spark: SparkSession) -> None:
    """Registers the table functions and the functions over texts for a session."""
    for name, kind in TABLES.items():
        spark.udtf.register(name, table_function(kind, name in CHOSEN))
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
