"""Queries over texts: metrics, language, readability, search, personal data, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import content, html, pages, pii, spans, text
from foliant.operators import office
from foliant.sources.files import decode
from foliant.sources.tables import table

_q = lambda x: "'" + x.replace("'", "''") + "'"


# ---- metrics


def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.word_count(t).alias("word_count"), text.char_count(t).alias("char_count"), text.line_count(t).alias("line_count"), text.language(t).alias("language"))


def _language(column: str = "text") -> str:
    tokens = f"string_split_regex(lower({column}), {_q(text.TOKEN_BREAK)})"
    score = {k: f"len(list_filter({tokens}, lambda x: x IN ({', '.join(map(_q, words))})))" for k, words in text.MARKERS.items()}
    best = f"greatest({', '.join(score.values())})"
    whens = " ".join(f"WHEN {s} = {best} THEN '{k}'" for k, s in score.items())
    trimmed = f"length(regexp_replace({column}, '^[{text.SPACE}]+|[{text.SPACE}]+$', '', 'g'))"
    return f"CASE WHEN {trimmed} < {text.LEAST_LENGTH} OR {best} = 0 THEN NULL {whens} END"


_LINES = r"CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - ends_with(text, chr(10))::INT END"
_WORDS = f"len(regexp_extract_all(text, {_q(text.WORD)}))"

TEXT_METRICS = f"SELECT doc_id, {_WORDS}::INT AS word_count, length(text)::INT AS char_count, ({_LINES})::INT AS line_count, {_language()} AS language FROM documents"


def base_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of texts after they were decoded from bytes, two of which are no UTF-8."""
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF61")))
    return table(spark, sf, "documents").select("doc_id", text.base_metrics(decode(raw)).alias("m")).select("doc_id", "m.*")


BASE_METRICS = f"""
WITH d AS (SELECT doc_id, text || chr(65533) || 'a' AS text FROM documents)
SELECT doc_id, {_WORDS}::INT AS word_count, length(text)::INT AS char_count, NULL::INT AS token_count, ({_LINES})::INT AS line_count, {_language()} AS language FROM d"""


def line_census(spark: SparkSession, sf: str) -> DataFrame:
    """Over pages with other line ends written in: CRLF in even ids, CR in every seventh."""
    mixed = F.when(F.col("page_id") % 7 == 0, F.concat(F.replace("html", F.lit("><"), F.lit(">\r<")), F.lit("\r"))).when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("><"), F.lit(">\r\n<"))).otherwise(F.concat("html", F.lit("\n")))
    rows = table(spark, sf, "pages").select("page_id", mixed.alias("t"))
    n = text.line_breaks(F.col("t"))
    return rows.select("page_id", *[c.alias(k) for k, c in n.items()], text.line_ending(F.col("t")).alias("ending"), text.ends_with_newline(F.col("t")).alias("ends_with_newline"))


LINE_CENSUS = """
WITH t AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN replace(html, '><', '>' || chr(13) || '<') || chr(13)
  WHEN page_id % 2 = 0 THEN replace(html, '><', '>' || chr(13) || chr(10) || '<') ELSE html || chr(10) END AS t FROM pages),
n AS (SELECT page_id, t, (len(string_split(t, chr(13) || chr(10))) - 1)::INT AS crlf, (len(string_split(t, chr(10))) - 1)::INT AS a, (len(string_split(t, chr(13))) - 1)::INT AS b FROM t),
m AS (SELECT page_id, t, crlf, a - crlf AS lf, b - crlf AS cr FROM n)
SELECT page_id, crlf, lf, cr, CASE (crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT WHEN 0 THEN 'none' WHEN 1 THEN CASE WHEN crlf > 0 THEN 'crlf' WHEN lf > 0 THEN 'lf' ELSE 'cr' END ELSE 'mixed' END AS ending,
  ends_with(t, chr(10)) OR ends_with(t, chr(13)) AS ends_with_newline FROM m"""


def language_confusion(spark: SparkSession, sf: str) -> DataFrame:
    guess = text.language(F.col("text")).alias("guess")
    return table(spark, sf, "documents").select("lang", guess).groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("documents"))


LANGUAGE_CONFUSION = f"SELECT lang, {_language()} AS guess, count(*) AS documents FROM documents GROUP BY ALL"


# ---- readability


def readability(spark: SparkSession, sf: str) -> DataFrame:
    r = text.readability(F.col("text")).alias("r")
    return table(spark, sf, "documents").select("doc_id", r).select("doc_id", "r.*")


def _readability(keys: str, lang: str = "en") -> str:
    bands = " ".join(f"WHEN ease >= {least} THEN {_q(said)}" for least, said in text.BANDS[lang] if least is not None)
    syllables = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(regexp_replace(lower(w), 'e$', ''), '[aeiouy]+')), 1) END"
    cents = lambda x: f"CASE WHEN word_count > 0 THEN round_even({x} * 100, 0) / 100 ELSE 0.0 END"
    return f"""
WITH w AS (SELECT {keys}, list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: {syllables}) AS s,
  greatest(len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: NOT regexp_matches(x, '{text.BLANK}'))), 1) AS n FROM documents),
c AS (SELECT *, len(s)::INT AS word_count, coalesce(list_sum(s), 0)::INT AS syllable_count, len(list_filter(s, lambda x: x >= 3))::INT AS complex_word_count FROM w),
e AS (SELECT *, word_count::DOUBLE / n::DOUBLE AS l, syllable_count::DOUBLE / word_count AS p FROM c),
f AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * l - 84.6::DOUBLE * p AS ease, 0.39::DOUBLE * l + 11.8::DOUBLE * p - 15.59::DOUBLE AS grade,
  0.4::DOUBLE * (l + 100.0::DOUBLE * complex_word_count / word_count) AS fog, 1.043::DOUBLE * sqrt(complex_word_count * (30.0::DOUBLE / n)) + 3.1291::DOUBLE AS smog FROM e),
r AS (SELECT {keys}, word_count, CASE WHEN word_count > 0 THEN n ELSE 0 END::INT AS sentence_count, syllable_count, complex_word_count, {cents('ease')} AS flesch_reading_ease,
  {cents('grade')} AS flesch_kincaid_grade, {cents('fog')} AS gunning_fog_index, {cents('smog')} AS smog_index,
  CASE WHEN word_count = 0 THEN {_q(text.NO_TEXT[lang])} {bands} ELSE {_q(text.BANDS[lang][-1][1])} END AS interpretation FROM f)
"""


READABILITY = _readability("doc_id") + "SELECT * FROM r"


def readability_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, every seventh of which has lost all but its white space, and what is refused."""
    given = F.when(F.col("doc_id") % 7 == 3, F.regexp_replace("text", r"[^ \n\t]", " ")).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", text.readability_or_problem(given).alias("r"))
    return rows.select("doc_id", F.col("r.readability.word_count").alias("word_count"), F.col("r.problem.status").alias("status"))


READABILITY_CHECKED = f"""
WITH b AS (SELECT doc_id, text, text IS NULL OR doc_id % 7 = 3 OR regexp_matches(text, '{text.BLANK}') AS none FROM documents)
SELECT doc_id, CASE WHEN NOT none THEN len(regexp_extract_all(text, '[a-zA-Z]+'))::INT END AS word_count, CASE WHEN none THEN 400::INT END AS status FROM b"""


def readability_bands(spark: SparkSession, sf: str) -> DataFrame:
    band = text.readability(F.col("text"), "es")["interpretation"].alias("interpretation")
    return table(spark, sf, "documents").select("lang", band).groupBy("lang", "interpretation").agg(F.count(F.lit(1)).alias("documents"))


READABILITY_BANDS = _readability("doc_id, lang", "es") + "SELECT lang, interpretation, count(*) AS documents FROM r GROUP BY ALL"


def readability_by_source(spark: SparkSession, sf: str) -> DataFrame:
    r = text.readability(F.col("text"))
    rows = table(spark, sf, "documents").select("source", r["word_count"].alias("w"), r["flesch_reading_ease"].cast("decimal(12,2)").alias("e"))
    return rows.groupBy("source").agg(F.sum("w").alias("words"), F.sum("e").cast("double").alias("total_ease"), F.max("e").cast("double").alias("easiest"))


READABILITY_BY_SOURCE = _readability("doc_id, source") + "SELECT source, sum(word_count)::BIGINT AS words, sum(flesch_reading_ease::DECIMAL(12,2))::DOUBLE AS total_ease, max(flesch_reading_ease::DECIMAL(12,2))::DOUBLE AS easiest FROM r GROUP BY source"


def syllable_histogram(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(text.letters(F.col("text"))).alias("w"))
    return words.groupBy(text.syllables(F.col("w")).alias("syllables")).agg(F.count(F.lit(1)).alias("words"))


SYLLABLE_HISTOGRAM = """
WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM documents)
SELECT (CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(regexp_replace(lower(w), 'e$', ''), '[aeiouy]+')), 1) END)::INT AS syllables, count(*) AS words FROM w GROUP BY 1"""


# ---- heuristics over lines


def heading_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    x = F.col("line")
    told = lines.withColumns({"heading": text.is_heading(x), "subheading": text.is_subheading(x), "document_heading": text.is_document_heading(x)})
    return told.where("heading OR subheading OR document_heading").select("doc_id", "line_no", F.md5("line").alias("line_md5"), "heading", "subheading", "document_heading")


HEADING_LINES = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a)))::INT AS line_no FROM l),
h AS (SELECT doc_id, line_no, line, length(line) BETWEEN 3 AND 79 AND NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '\p{L}') AND NOT contains(line, chr(9)) AS heading,
  length(line) BETWEEN 3 AND 99 AND NOT ends_with(line, '.') AND (ends_with(line, ':') OR (regexp_matches(line, '^\p{Lu}') AND length(line) - length(replace(line, ' ', '')) <= 6)) AS subheading,
  length(line) BETWEEN 1 AND 79 AND NOT ends_with(line, '.') AND NOT ends_with(line, ',') AND len(string_split(line, ' ')) <= 12 AS document_heading FROM x)
SELECT doc_id, line_no, md5(line) AS line_md5, heading, subheading, document_heading FROM h WHERE heading OR subheading OR document_heading"""


def table_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.table_runs(F.col("text")).alias("tables"))


TABLE_RUNS = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a, regexp_matches(text, '{text.BLANK}') AS blank FROM documents),
m AS (SELECT doc_id, blank, array_to_string(list_transform(a, lambda x: CASE WHEN len(string_split(x, chr(9))) > 2 OR len(string_split(x, '|')) > 2
  OR len(regexp_extract_all(x, '[{text.SPACE}]{{3,}}')) >= 2 THEN 't' ELSE '-' END), '') AS marks FROM l)
SELECT doc_id, (CASE WHEN blank THEN 0 ELSE len(regexp_extract_all(marks, 'tt+')) END)::INT AS tables FROM m"""


# ---- search


def _spans(source: str, key: str, column: str, pattern: str, context: int) -> str:
    """Rows (key, match, start, end, context) of a pattern's matches."""
    p = _q(pattern)
    return f"""
SELECT {key}, m[k] AS "match", (coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS "start", t
FROM (SELECT {key}, t, m, g, unnest(range(1, len(m) + 1)) AS k FROM (SELECT {key}, {column} AS t, regexp_extract_all({column}, {p}) AS m, string_split_regex({column}, {p}) AS g FROM {source}))"""


def _found(source: str, key: str, column: str, pattern: str, context: int = 80) -> str:
    return f"""
SELECT {key}, "match", "start", ("start" + length("match"))::INT AS "end",
  substring(t, greatest("start" - {context}, 0)::BIGINT + 1, ("start" + length("match") + {context} - greatest("start" - {context}, 0))::BIGINT) AS context
FROM ({_spans(source, key, column, pattern, context)})"""


def _search(df: DataFrame, key: list[str], **how) -> DataFrame:
    hits = df.select(*key, F.explode(spans.search(F.col("text"), **how)).alias("m"))
    return hits.select(*key, "m.match", "m.start", "m.end", "m.context")


def search_literal(spark: SparkSession, sf: str) -> DataFrame:
    return _search(table(spark, sf, "documents"), ["doc_id"], query="worthless")


SEARCH_LITERAL = _found("documents", "doc_id", "text", "(?i)worthless")


def search_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _search(table(spark, sf, "documents"), ["doc_id"], pattern=r"[A-Z][a-z]+tion[,.]", context=12)


SEARCH_REGEX = _found("documents", "doc_id", "text", r"[A-Z][a-z]+tion[,.]", 12)


def search_deadline(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of a pattern whose turns can be read in several ways, each document under a deadline."""
    found = spans.search_within(F.col("text"), "(?:an|ana|in|ing)+[st]", seconds=60, context=5)
    rows = table(spark, sf, "documents").select("doc_id", found.alias("f"))
    texts = F.array_join(F.transform("f.spans", lambda m: m["match"]), " ")
    return rows.select("doc_id", F.size("f.spans").cast("int").alias("matches"), F.sha2(texts, 256).alias("found_sha256"), F.col("f.problem.status").alias("status"))


SEARCH_DEADLINE = """
WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?:an|ana|in|ing)+[st]') AS m FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(m)::INT AS matches, sha256(array_to_string(m, ' ')) AS found_sha256, NULL::INT AS status FROM m"""


def search_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as sections of conversations, searched one by one."""
    return _search(table(spark, sf, "conversations"), ["conv_id", "turn"], query="the th", context=20)


SEARCH_SECTIONS = _found("conversations", "conv_id, turn", "text", "(?i)the th", 20)


def search_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as files, turns as their rows: the end of a sentence and the first word of the next line, which may be
    in the next turn."""
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("place"), "text")
    return office.search_joined(turns, "conv_id", pattern=r"[a-z]+\.\n[A-Z][a-z]+", context=8).select("conv_id", "match", "start", "end", "context")


SEARCH_JOINED = f"""
SELECT conv_id, "match", "start"::BIGINT AS "start", "end"::BIGINT AS "end", context FROM
({_found("(SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)", "conv_id", "text", "[a-z]+\\.\\n[A-Z][a-z]+", 8)})"""


def search_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Matches per document under a file name's label, as the search over files of any kind reports them."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "docx", "xlsx", "pptx", "txt")]), (F.col("doc_id") % 5 + 1).cast("int"))
    label = F.when(ext == "pdf", "page").when(ext == "docx", "paragraph").when(ext == "xlsx", "sheet").when(ext == "pptx", "slide").otherwise("section")
    return table(spark, sf, "documents").select("doc_id", label.alias("label"), F.regexp_count("text", F.lit(spans.literal("tion"))).cast("int").alias("matches"))


SEARCH_COUNTS = """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'sheet' WHEN 3 THEN 'slide' ELSE 'section' END AS label,
  len(regexp_extract_all(text, '(?i)tion'))::INT AS matches FROM documents"""


# ---- personal data


def pii_matches(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_matches(table(spark, sf, "documents"), "doc_id")


def _pii(source: str, key: str, column: str = "text") -> str:
    parts = " UNION ALL ".join(
        f"""SELECT {key}, {i} AS i, '{kind}' AS pii_type, {_q(country) if country else 'NULL'}::VARCHAR AS country, "match" AS value, "start", "end", context FROM ({_found(source, key, column, pattern, pii.CONTEXT)})"""
        for i, (pattern, kind, country) in enumerate(pii.PATTERNS)
    )
    return f"""(SELECT {key}, pii_type, country, value, "start", "end", context FROM ({parts}) QUALIFY row_number() OVER (PARTITION BY {key}, pii_type, "start", "end" ORDER BY i) = 1)"""


PII_MATCHES = f"""SELECT * FROM {_pii('documents', 'doc_id')}"""


def pii_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Matches and documents by type, country and language, with all subtotals, from one scan; grouping tells which
    columns a subtotal leaves open."""
    hits = pii.pii_matches(table(spark, sf, "documents"), "doc_id", "lang")
    sums = hits.cube("pii_type", "country", "lang").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("doc_id").alias("documents"), F.grouping_id().alias("grouping"))
    return sums.select("pii_type", "country", "lang", "grouping", "matches", "documents")


PII_CUBE = f"""
SELECT pii_type, country, lang, grouping(pii_type, country, lang)::BIGINT AS "grouping", count(*) AS matches, count(DISTINCT doc_id) AS documents
FROM {_pii('documents', 'doc_id')} JOIN documents USING (doc_id) GROUP BY CUBE (pii_type, country, lang)"""


def pii_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_matches(table(spark, sf, "pages"), "page_id", text="html")


PII_PAGES = f"SELECT * FROM {_pii('pages', 'page_id', 'html')}"


def pii_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_matches(table(spark, sf, "conversations"), "conv_id", "turn").groupBy("conv_id", "pii_type").agg(F.count(F.lit(1)).alias("matches"), F.min("turn").alias("first_turn"))


PII_CONVERSATIONS = f"SELECT conv_id, pii_type, count(*) AS matches, min(turn) AS first_turn FROM {_pii('conversations', 'conv_id, turn')} GROUP BY ALL"


def pii_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_matches(table(spark, sf, "documents"), "doc_id").groupBy("pii_type", "country").agg(F.count(F.lit(1)).alias("matches"))


PII_BY_TYPE = f"SELECT pii_type, country, count(*) AS matches FROM {_pii('documents', 'doc_id')} GROUP BY ALL"


def pii_by_document(spark: SparkSession, sf: str) -> DataFrame:
    found = F.transform(pii.pii(F.col("text")), lambda m: m["pii_type"])
    return table(spark, sf, "documents").select("doc_id", F.size(found).alias("total"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("types"))


PII_BY_DOCUMENT = f"""SELECT doc_id, count(pii_type)::INT AS total, coalesce(string_agg(DISTINCT pii_type, ',' ORDER BY pii_type), '') AS types
FROM documents LEFT JOIN {_pii('documents', 'doc_id')} USING (doc_id) GROUP BY doc_id"""


# ---- hashes and encodings


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "documents").select("doc_id", content.hashes(raw).alias("h"), content.composite_hash(name, raw).alias("composite")).select("doc_id", "h.*", "composite")


CONTENT_HASH = """SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1,
sha256('doc-' || doc_id || '.txt:' || octet_length(encode(text)) || ':' || text) AS composite FROM documents"""


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("copies > 1")


EXACT_DUPLICATES = "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1 HAVING count(*) > 1"

#: Bytes of every kind of encoding, in hexadecimal.
SAMPLES = ("EFBBBF61C3A9", "FFFE78006100", "FEFF00780061", "FFFE000078000000", "0000FEFF00000078", "61C3A9", "616263", "61E28262", "FF61", "")


def encoding_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of every encoding, and all documents by what is found in them."""
    samples = spark.createDataFrame([(x,) for x in SAMPLES], "sample string").select("sample", F.unhex("sample").alias("raw"))
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("sample"), F.col("text").cast("binary").alias("raw"))
    return samples.union(docs).select("sample", content.encoding(F.col("raw")).alias("e")).groupBy("sample", "e.encoding", "e.confidence", "e.has_bom").agg(F.count(F.lit(1)).alias("files"))


ENCODING_DETECT = """
SELECT * FROM (VALUES ('EFBBBF61C3A9', 'utf-8', 'certain', true, 1::BIGINT), ('FFFE78006100', 'utf-16le', 'certain', true, 1), ('FEFF00780061', 'utf-16be', 'certain', true, 1),
  ('FFFE000078000000', 'utf-32le', 'certain', true, 1), ('0000FEFF00000078', 'utf-32be', 'certain', true, 1), ('61C3A9', 'utf-8', 'high', false, 1), ('616263', 'us-ascii', 'certain', false, 1),
  ('61E28262', 'unknown', 'low', false, 1), ('FF61', 'unknown', 'low', false, 1), ('', 'us-ascii', 'certain', false, 1)) AS v(sample, encoding, confidence, has_bom, files)
UNION ALL SELECT 'documents', CASE WHEN length(text) = octet_length(encode(text)) THEN 'us-ascii' ELSE 'utf-8' END, CASE WHEN length(text) = octet_length(encode(text)) THEN 'certain' ELSE 'high' END, false, count(*)
FROM documents GROUP BY 2, 3"""


def transliterated(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in the characters of code page 1252, after some were put in that it hasn't got."""
    dirty = F.concat(F.lit("\u2192\u0151\u4e2d\u2019 "), "text", F.lit("\u2264\u200b"))
    return table(spark, sf, "documents").select("doc_id", F.md5(content.transliterate(dirty)).alias("md5"))


TRANSLITERATED = "SELECT doc_id, md5('->o?\u2019 ' || text || '<=') AS md5 FROM documents"


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.concat(F.lit("﻿\x07"), F.replace("text", F.lit(". "), F.lit(".\r")), F.lit("\x1b"))
    rows = table(spark, sf, "documents").select("doc_id", dirty.alias("t"))
    clean = content.normalise(F.col("t"), "crlf", strip_controls=True)
    return rows.select("doc_id", F.length(clean).alias("chars"), F.md5(clean).alias("md5"))


NORMALISED = """
WITH t AS (SELECT doc_id, replace(replace(replace(replace(text, '. ', '.' || chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10)) AS t FROM documents)
SELECT doc_id, length(t)::INT AS chars, md5(t) AS md5 FROM t"""


def control_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole texts, with control characters put in."""
    dirty = F.concat(F.substring("text", 1, 40), F.lit("\x07\n\x1b\x07"), F.substring("text", 41, 20), F.lit("\x7f"), F.expr("substring(text, 61)"))
    rows = table(spark, sf, "documents").select("doc_id", dirty.alias("t"))
    return rows.select("doc_id", F.explode(content.control_census(F.col("t"))).alias("c")).select("doc_id", "c.*")


CONTROL_BYTES = r"""
WITH t AS (SELECT doc_id, substring(text, 1, 40) || chr(7) || chr(10) || chr(27) || chr(7) || substring(text, 41, 20) || chr(127) || substring(text, 61) AS t FROM documents),
c AS (SELECT doc_id, t, code, name, instr(t, chr(code))::INT AS p FROM t, (VALUES (7, 'BEL'), (27, 'ESC'), (127, 'DEL')) AS v(code, name))
SELECT doc_id, code::INT AS code, name, octet_length(encode(substring(t, 1, p - 1)))::INT AS "offset", len(string_split(substring(t, 1, p - 1), chr(10)))::INT AS line,
  (octet_length(encode(string_split(substring(t, 1, p - 1), chr(10))[-1])) + 1)::INT AS col, (len(string_split(t, chr(code))) - 1)::INT AS occurrences FROM c"""


# ---- HTML


def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


def _decoded(x: str) -> str:
    """The entities that the pages hold, decoded."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


HTML_TITLE = f"""SELECT page_id, nullif(trim({_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}), '') AS title FROM pages"""


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.to_text(F.col("html")).alias("text"))


def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.to_markdown(F.col("html")).alias("markdown"))


def _pages(markdown: bool) -> str:
    """The pages' body cut at tags of blocks; each piece keeps its first tag, which tells what it is. Enough for these
    pages, which hold no pre, tables, ordered lists or quotes, and built otherwise than the scan that it checks."""
    cut = "(?i)<(/?)(p|div|article|footer|section|header|h1|h2|h3|ul|li|body)(\\s[^>]*)?>"
    piece = "regexp_replace(b, '^\\x01([^\\x02]*)\\x02', '')"
    if markdown:
        piece = f"regexp_replace({piece}, '(?i)</?(b|strong)>', '**', 'g')"
        piece = f"regexp_replace({piece}, '(?i)</?(i|em)>', '*', 'g')"
        piece = f"""regexp_replace({piece}, '(?i)<a\\s[^>]*href="([^"#][^"]*)"[^>]*>(.*?)</a>', '[\\2](\\1)', 'g')"""
    piece = f"regexp_replace(regexp_replace({piece}, '(?i)<br\\s*/?>', chr(3), 'g'), '<[^>]*>', '', 'g')"
    said = f"replace(regexp_replace(regexp_replace({_decoded(piece)}, '[\\s]+', ' ', 'g'), '\\x03 ', chr(3), 'g'), chr(3), chr(10))"
    said = f"regexp_replace({said}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    mark = "CASE regexp_extract(b, '^\\x01([a-z0-9/]*)', 1) WHEN 'h1' THEN '# ' WHEN 'h2' THEN '## ' WHEN 'h3' THEN '### ' WHEN 'li' THEN '- ' ELSE '' END ||" if markdown else ""
    return f"""
WITH body AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<head.*?</head>', ''), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
cut AS (SELECT page_id, string_split(regexp_replace(h, '{cut}', chr(4) || chr(1) || '\\1\\2' || chr(2), 'g'), chr(4)) AS bs FROM body),
b AS (SELECT page_id, unnest(bs) AS b, unnest(range(len(bs))) AS i FROM cut),
s AS (SELECT page_id, i, {mark} {said} AS s, {said} AS bare FROM b)
SELECT page_id, coalesce(string_agg(s, chr(10) || chr(10) ORDER BY i) FILTER (bare <> ''), '') AS {"markdown" if markdown else "text"} FROM s GROUP BY page_id"""


HTML_TO_TEXT, HTML_TO_MARKDOWN = _pages(False), _pages(True)


# ---- pages of conversations


def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Specifications made from ids, some of them wrong."""
    spec = F.expr("CASE conv_id % 6 WHEN 0 THEN '1' WHEN 1 THEN ' 1 , 2-2,1' WHEN 2 THEN '2-1' WHEN 3 THEN concat('1-', turns) WHEN 4 THEN concat(turns + 1, '') ELSE 'x,1' END")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("turns"))
    return turns.withColumn("spec", spec).select("conv_id", "spec", F.array_join(F.transform(pages.ranges(F.col("spec"), F.col("turns")), lambda x: x.cast("string")), ",").alias("pages"))


PAGE_RANGES = """
WITH t AS (SELECT conv_id, count(*)::INT AS turns FROM conversations GROUP BY 1)
SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN '1' WHEN 1 THEN ' 1 , 2-2,1' WHEN 2 THEN '2-1' WHEN 3 THEN '1-' || turns WHEN 4 THEN (turns + 1)::VARCHAR ELSE 'x,1' END AS spec,
  CASE conv_id % 6 WHEN 0 THEN '0' WHEN 1 THEN CASE WHEN turns >= 2 THEN '0,1' END WHEN 3 THEN array_to_string(range(turns), ',') END AS pages FROM t"""


def page_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations, 200 at most, without the first, turned around, and the first one turned."""
    name = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 200).cast("string")).alias("file")
    turns = table(spark, sf, "conversations").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))).alias("p"))
    p = F.transform("p", lambda x: x["m"])
    back = F.sequence(F.size("p"), F.lit(1), F.lit(-1))
    return turns.select("file", F.array_join(pages.rotate(F.transform("p", lambda _: F.lit(270)), F.array(F.lit(0)), 180), ",").alias("angles"), F.array_join(pages.delete(p, F.array(F.lit(0))), ",").alias("deleted"), F.array_join(pages.reorder(p, back), ",").alias("reordered"), F.array_join(pages.select(p, F.array(F.lit(0))), ",").alias("selected"))


PAGE_EDITS = """
WITH t AS (SELECT conv_id || '-' || (turn // 200) AS file, list(md5(text) ORDER BY turn) AS p FROM conversations GROUP BY 1)
SELECT file, '90' || repeat(',270', len(p)::INT - 1) AS angles, CASE WHEN len(p) > 1 THEN array_to_string(p[2:], ',') END AS deleted, array_to_string(list_reverse(p), ',') AS reordered, p[1] AS selected FROM t"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (text_metrics, TEXT_METRICS), (base_metrics, BASE_METRICS), (line_census, LINE_CENSUS), (language_confusion, LANGUAGE_CONFUSION), (readability, READABILITY), (readability_bands, READABILITY_BANDS), (readability_checked, READABILITY_CHECKED),
        (readability_by_source, READABILITY_BY_SOURCE), (syllable_histogram, SYLLABLE_HISTOGRAM), (heading_lines, HEADING_LINES), (table_runs, TABLE_RUNS), (search_literal, SEARCH_LITERAL),
        (search_regex, SEARCH_REGEX), (search_deadline, SEARCH_DEADLINE), (search_sections, SEARCH_SECTIONS), (search_counts, SEARCH_COUNTS), (search_joined, SEARCH_JOINED), (pii_matches, PII_MATCHES), (pii_cube, PII_CUBE), (pii_pages, PII_PAGES), (pii_conversations, PII_CONVERSATIONS),
        (pii_by_type, PII_BY_TYPE), (pii_by_document, PII_BY_DOCUMENT), (content_hash, CONTENT_HASH), (exact_duplicates, EXACT_DUPLICATES), (encoding_detect, ENCODING_DETECT), (normalised, NORMALISED), (transliterated, TRANSLITERATED),
        (control_bytes, CONTROL_BYTES), (html_title, HTML_TITLE), (html_to_text, HTML_TO_TEXT), (html_to_markdown, HTML_TO_MARKDOWN), (page_ranges, PAGE_RANGES), (page_edits, PAGE_EDITS),
    )
}
