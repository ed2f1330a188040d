"""All registered queries and their SQL."""

from __future__ import annotations

from foliant.plans import books, files, office, texts

ALL = texts.QUERIES | books.QUERIES | files.QUERIES | office.QUERIES
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
