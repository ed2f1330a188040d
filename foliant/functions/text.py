"""Text metrics, language guess, readability and line heuristics."""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.sources.files import problem
from pyspark.sql.types import IntegerType

#: Unicode white space, in a form that Java and RE2 read alike.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD, BLANK = f"[^{SPACE}]+", f"^[{SPACE}]*$"
TOKEN_BREAK = r"""[ \t\r\n.,;:!?()\[\]{}"']+"""
#: Function words of each language, in the order in which ties are settled.
MARKERS = {
    "en": ("the", "and", "is", "of", "to"),
    "es": ("el", "de", "la", "en", "que", "los"),
    "fr": ("le", "les", "des", "est", "une"),
    "de": ("der", "die", "und", "das", "ist"),
}
LEAST_LENGTH = 20
#: Least reading ease of each band and its description.
BANDS = {
    "en": (
        (90, "Very easy to read (5th grade)"),
        (80, "Easy to read (6th grade)"),
        (70, "Fairly easy to read (7th grade)"),
        (60, "Standard / plain English (8th-9th grade)"),
        (50, "Fairly difficult to read (10th-12th grade)"),
        (30, "Difficult to read (college level)"),
        (None, "Very difficult to read (college graduate level)"),
    ),
    "es": (
        (90, "Muy fácil de leer (5.º grado)"),
        (80, "Fácil de leer (6.º grado)"),
        (70, "Bastante fácil de leer (7.º grado)"),
        (60, "Inglés estándar / sencillo (8.º-9.º grado)"),
        (50, "Bastante difícil de leer (10.º-12.º grado)"),
        (30, "Difícil de leer (nivel universitario)"),
        (None, "Muy difícil de leer (nivel posgrado)"),
    ),
}
NO_TEXT = {"en": "Document contains no analysable text", "es": "Documento sin texto analizable"}


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_blank(text: Column) -> Column:
    return text.rlike(BLANK)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("int")


def char_count(text: Column) -> Column:
    """Code points."""
    return F.length(text)


def ends_with_newline(text: Column) -> Column:
    return F.coalesce(F.endswith(text, F.lit("\n")) | F.endswith(text, F.lit("\r")), F.lit(False))


def line_count(text: Column) -> Column:
    """Lines that LF ends or begins; an empty text has none and a lone CR ends none."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + 1 - F.endswith(text, F.lit("\n")).cast("int")).cast("int")


def line_breaks(text: Column) -> dict[str, Column]:
    """Numbers of CRLF, LF and CR."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("int")
    return {"crlf": count("\r\n"), "lf": count("(?<!\r)\n"), "cr": count("\r(?!\n)")}


def line_ending(text: Column) -> Column:
    """none, mixed, crlf, lf or cr."""
    n = line_breaks(text)
    kinds = sum(((c > 0).cast("int") for c in n.values()), F.lit(0))
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(n["crlf"] > 0, "crlf").when(n["lf"] > 0, "lf").otherwise("cr")


def marker_counts(text: Column) -> Column:
    """struct of the numbers of function words of each language; sums over parts of a text tell the text's language."""
    # one scan finds the function words of all languages, so that other tokens never become values
    every = "|".join(sorted({w for words in MARKERS.values() for w in words}))
    apart = TOKEN_BREAK.removesuffix("+").replace("[", "[^", 1)
    marks = F.regexp_extract_all(F.lower(text), F.lit(f"(?<!{apart})(?:{every})(?!{apart})"), F.lit(0))
    return bound(marks, lambda found: F.struct(*[F.size(F.filter(found, _among(words))).alias(k) for k, words in MARKERS.items()]))


def most_marked(counts: Column) -> Column:
    """The language with most function words, the first of several; null without any."""
    best, guess = F.greatest(*[counts[k] for k in MARKERS]), F.lit(None).cast("string")
    for k in reversed(MARKERS):
        guess = F.when(counts[k] == best, k).otherwise(guess)
    return F.when(best > 0, guess)


def language(text: Column) -> Column:
    """The language with most function words; null for short texts and those without any."""
    long_enough = text.rlike(f"(?s)[^{SPACE}].{{{LEAST_LENGTH - 2},}}[^{SPACE}]")
    return F.when(long_enough, bound(marker_counts(text), most_marked))


def _among(words):
    return lambda x: x.isin(*words)


def syllables(word: Column) -> Column:
    low = F.lower(word)
    stem = F.regexp_replace(low, "e$", "")
    groups = F.greatest(F.regexp_count(stem, F.lit("[aeiouy]+")), F.lit(1))
    return F.when(F.length(low) == 0, 0).when(F.length(low) <= 3, 1).otherwise(groups).cast("int")


def letters(text: Column) -> Column:
    """The runs of ASCII letters."""
    return F.regexp_extract_all(text, F.lit("([a-zA-Z]+)"), F.lit(1))


def _cents(x: Column) -> Column:
    return F.rint(x * 100) / 100


def readability(text: Column, lang: str = "en") -> Column:
    """A struct of counts, the four indices and the interpretation; zeros for a text without letters."""
    if lang not in BANDS:
        lang = "en"
    sentences = F.greatest(F.size(F.filter(F.split(text, "[.!?]+"), lambda s: ~is_blank(s))), F.lit(1))

    def counts(per_word: Column) -> Column:
        return F.struct(
            F.size(per_word).alias("words"),
            sentences.alias("sentences"),
            F.aggregate(per_word, F.lit(0), lambda acc, n: acc + n).alias("syllables"),
            F.size(F.filter(per_word, lambda n: n >= 3)).alias("complex"),
        )

    def indices(n: Column) -> Column:
        w, s, c = n["words"].cast("double"), n["sentences"].cast("double"), n["complex"].cast("double")
        length, per = w / s, n["syllables"] / w
        ease = 206.835 - 1.015 * length - 84.6 * per
        grade = 0.39 * length + 11.8 * per - 15.59
        fog = 0.4 * (length + 100.0 * c / w)
        smog = 1.0430 * F.sqrt(c * (30.0 / s)) + 3.1291
        band = F.lit(BANDS[lang][-1][1])
        for least, said in reversed(BANDS[lang][:-1]):
            band = F.when(ease >= least, said).otherwise(band)
        some = n["words"] > 0
        zero = lambda x: F.when(some, x).otherwise(F.lit(0.0))
        return F.struct(
            n["words"].alias("word_count"),
            F.when(some, n["sentences"]).otherwise(0).alias("sentence_count"),
            n["syllables"].alias("syllable_count"),
            n["complex"].alias("complex_word_count"),
            zero(_cents(ease)).alias("flesch_reading_ease"),
            zero(_cents(grade)).alias("flesch_kincaid_grade"),
            zero(_cents(fog)).alias("gunning_fog_index"),
            zero(_cents(smog)).alias("smog_index"),
            F.when(some, band).otherwise(NO_TEXT[lang]).alias("interpretation"),
        )

    return bound(bound(F.transform(letters(text), syllables), counts), indices)


def readability_or_problem(text: Column, lang: str = "en") -> Column:
    """struct(readability, problem): a text without anything but white space has no indices but a problem (400)."""
    none = text.isNull() | is_blank(text)
    return F.struct(F.when(~none, readability(text, lang)).alias("readability"), F.when(none, problem(400, F.lit("there is no text"))).alias("problem"))


def base_metrics(text: Column, tokens: Column | None = None) -> Column:
    """A struct of words, characters, tokens (null unless a count is given), lines and language."""
    tokens = F.lit(None).cast("int") if tokens is None else tokens
    return F.struct(word_count(text).alias("word_count"), char_count(text).alias("char_count"), tokens.alias("token_count"), line_count(text).alias("line_count"), language(text).alias("language"))


def token_count(text: Column, ranks: str, pattern: str) -> Column:
    """Tokens of a byte-pair encoding whose ranks are in a file (a line of base64 and rank each) that every node can read."""

    @F.arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        encoding = _encoding(ranks, pattern)
        return pa.array([None if x is None else len(encoding.encode_ordinary(x)) for x in texts.to_pylist()], pa.int32())

    return count(text)


@cache
def _encoding(ranks: str, pattern: str):
    """Kept in the worker from batch to batch."""
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=known, special_tokens={})


def is_heading(line: Column) -> Column:
    """Short lines of capitals with a letter and no tab."""
    return F.length(line).between(3, 79) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{L}") & ~line.contains("\t")


def is_subheading(line: Column) -> Column:
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.length(line).between(3, 99) & ~line.endswith(".") & (line.endswith(":") | (line.rlike(r"^\p{Lu}") & (spaces <= 6)))


def is_document_heading(line: Column) -> Column:
    return F.length(line).between(1, 79) & ~line.endswith(".") & ~line.endswith(",") & (F.size(F.split(line, " ")) <= 12)


def table_runs(text: Column) -> Column:
    """Runs of two or more lines with two or more tabs, pipes or gaps of three white-space characters."""
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    tabular = lambda x: (count(x, "\t") >= 2) | (count(x, "|") >= 2) | (F.regexp_count(x, F.lit(f"[{SPACE}]{{3,}}")) >= 2)
    marks = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(tabular(x), "t").otherwise("-")), "")
    return F.when(is_blank(text), 0).otherwise(F.regexp_count(marks, F.lit("tt+"))).cast("int")
