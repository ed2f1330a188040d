"""Personal data: spans of 19 patterns over a text, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.spans import matches, places
from foliant.functions.text import bound

CONTEXT = 60
#: What every pattern needs: texts without it are spared the patterns.
NEEDED = r"(?U)[\d@]"
#: Pattern, type and country, in the order in which equal spans of a type are settled.
PATTERNS = (
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "email", None),
    (r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "credit_card_visa", None),
    (r"\b5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "credit_card_mastercard", None),
    (r"\b3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d{5}\b", "credit_card_amex", None),
    (r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{0,4}\b", "iban", "EU"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "ssn", "US"),
    (r"\b(?:\+1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b", "phone", "US"),
    (r"\b\d{8}[A-Z]\b", "dni", "ES"),
    (r"\b[XYZ]\d{7}[A-Z]\b", "nie", "ES"),
    (r"\b(?:\+34)[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}\b", "phone", "ES"),
    (r"\b[12]\s?\d{2}\s?(?:0[1-9]|1[0-2])\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b", "insee_ssn", "FR"),
    (r"\b(?:\+33)[\s.\-]?\d[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}\b", "phone", "FR"),
    (r"\b(?:\+49)[\s.\-]?\d{2,5}[\s.\-]?\d{3,8}\b", "phone", "DE"),
    (r"\b[A-Z]{6}\d{2}[A-EHLMPR-T](?:0[1-9]|[12]\d|3[01])[A-Z]\d{3}[A-Z]\b", "codice_fiscale", "IT"),
    (r"\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", "national_insurance", "UK"),
    (r"\b(?:\+44)[\s.\-]?\d{4}[\s.\-]?\d{6}\b", "phone", "UK"),
    (r"\b(?:\+351)[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}\b", "phone", "PT"),
    (r"\b(?:0[1-9]|[12]\d|3[01])[/\-.](?:0[1-9]|1[0-2])[/\-.](?:19|20)\d{2}\b", "date_of_birth", None),
    (r"\b(?:19|20)\d{2}[/\-.](?:0[1-9]|1[0-2])[/\-.](?:0[1-9]|[12]\d|3[01])\b", "date_of_birth", None),
)


#: What a text must hold for some patterns to match at all.
HINTS = {"email": "@", ("phone", "ES"): "+34", ("phone", "FR"): "+33", ("phone", "DE"): "+49", ("phone", "UK"): "+44", ("phone", "PT"): "+351"}


def pii(text: Column) -> Column:
    """Array of structs (start, pii_type, end, country, value, context). Of equal spans of a type the one of
    the first pattern stays; a blank text has none. The array is in order of start, type and end."""
    each = []
    for rank, (pattern, kind, country) in enumerate(PATTERNS):
        hint = HINTS.get(kind) or HINTS.get((kind, country))
        m = matches(text, f"(?U){pattern}")
        found = F.when(text.contains(hint), m["found"]).otherwise(F.array().cast("array<string>")) if hint else m["found"]
        each.append(F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("pii_type"), F.lit(country).cast("string").alias("country"), m["pattern"].alias("pattern"), found.alias("found")))

    def tagged(m):
        return F.transform(places(text, m, CONTEXT), lambda s: F.struct(s["start"].alias("start"), m["pii_type"].alias("pii_type"), s["end"].alias("end"), m["rank"].alias("rank"), m["country"].alias("country"), s["match"].alias("value"), s["context"].alias("context")))

    some = F.filter(F.array(*each), lambda m: F.size(m["found"]) > 0)
    same = lambda x, y: (y["pii_type"] == x["pii_type"]) & (y["start"] == x["start"]) & (y["end"] == x["end"])
    # in order, equal spans are neighbours
    first = lambda every: F.filter(every, lambda x, i: (i == 0) | ~same(x, F.element_at(every, F.greatest(i, F.lit(1)))))
    told = F.transform(bound(F.array_sort(F.flatten(F.transform(some, tagged))), first), lambda x: x.dropFields("rank"))
    return F.when(text.rlike(NEEDED), told).otherwise(F.array())


def pii_matches(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """A row for each match: keys, pii_type, country, value, start, end, context."""
    hits = df.select(*keys, F.explode(pii(F.col(text))).alias("m"))
    return hits.select(*keys, "m.pii_type", "m.country", "m.value", "m.start", "m.end", "m.context")
