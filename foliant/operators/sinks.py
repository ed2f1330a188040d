"""Rows as text: Markdown tables, delimited lines and JSON objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def markdown_cell(cell: Column) -> Column:
    return F.regexp_replace(F.replace(cell, F.lit("|"), F.lit("\\|")), "[\r\n]", " ")


def markdown_rows(df: DataFrame, *names: str) -> DataFrame:
    """df with markdown, the row's line of a table."""
    return df.withColumn("markdown", F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(_text(n)) for n in names]), F.lit(" |")))


def markdown_header(*names: str) -> str:
    return "| " + " | ".join(n.replace("|", "\\|") for n in names) + " |\n|" + " --- |" * len(names)


def csv_cell(cell: Column) -> Column:
    """Quoted if it holds a comma, a quote or LF."""
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike('[,"\n]'), quoted).otherwise(cell)


def csv_rows(df: DataFrame, *names: str) -> DataFrame:
    """df with csv, the row as a delimited line."""
    return df.withColumn("csv", F.concat_ws(",", *[csv_cell(_text(n)) for n in names]))


def json_rows(df: DataFrame, *names: str) -> DataFrame:
    """df with json, the row as an object of texts. Repeated names raise."""
    if len(set(names)) < len(names):
        raise ValueError("names repeat")
    return df.withColumn("json", F.to_json(F.struct(*[_text(n).alias(n) for n in names])))
