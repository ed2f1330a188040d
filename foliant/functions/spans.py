"""Where a pattern matches: spans with context, by expressions alone.

The matches and the gaps between them tell all offsets, so that no Python runs. Offsets are sums over
the gaps and matches before; they are taken in blocks of about the square root of their number, and
contexts are cut from pieces of the text, so that a text with very many matches costs little more than
each of them. Patterns must not match the empty text. Patterns that aren't safe run in Arrow workers under a deadline.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import bound
from foliant.sources.files import PROBLEM, TITLES

#: Characters of the pieces that contexts are cut from.
PIECE = 1024


def matches(text: Column, pattern: str) -> Column:
    """struct(pattern, found): what places reads. Only the matches; most texts have none, and need no more."""
    return F.struct(F.lit(pattern).alias("pattern"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))


def spans(text: Column, pattern: str, context: int = 80) -> Column:
    """Array of structs (match, start, end, context); offsets in code points from 0, the end exclusive."""
    return bound(matches(text, pattern), lambda m: places(text, m, context))


def places(text: Column, m: Column, context: int) -> Column:
    """The spans of matches m in the text."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    gaps = F.transform(F.split(text, m["pattern"], -1), lambda g: F.length(g))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    width = F.ceil(F.sqrt(F.size(m["found"]))).cast("int")

    def with_steps(p):
        steps = F.zip_with(p["gaps"], F.transform(m["found"], lambda x: F.length(x)), lambda g, n: g + F.coalesce(n, F.lit(0)))
        return F.struct(p["gaps"].alias("gaps"), p["pieces"].alias("pieces"), p["width"].alias("width"), steps.alias("steps"))

    def with_sums(p):
        each = F.transform(F.sequence(F.lit(0), p["width"]), lambda b: total(F.slice(p["steps"], b * p["width"] + 1, p["width"])))
        upto = bound(each, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, 1, b))))
        return F.struct(*[p[k].alias(k) for k in ("gaps", "pieces", "steps", "width")], upto.alias("upto"))

    def every(p):
        def place(match, i):
            block = F.floor(i / p["width"]).cast("int")
            inside = total(F.slice(p["steps"], block * p["width"] + 1, i % p["width"]))
            start = F.element_at(p["upto"], block + 1) + inside + F.element_at(p["gaps"], i + 1)
            return bound(F.struct(match.alias("match"), start.alias("start"), (start + F.length(match)).alias("end")), lambda s: told(p["pieces"], s))

        return F.transform(m["found"], place)

    def told(pieces, s):
        low = F.greatest(s["start"] - context, F.lit(0))
        first = F.floor(low / PIECE).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor((s["end"] + context) / PIECE).cast("int") - first + 1), "")
        return F.struct(s["match"].alias("match"), s["start"].alias("start"), s["end"].alias("end"), F.substring(near, low - first * PIECE + 1, s["end"] + context - low).alias("context"))

    parts = F.struct(gaps.alias("gaps"), pieces.alias("pieces"), width.alias("width"))
    return F.when(F.size(m["found"]) > 0, bound(bound(bound(parts, with_steps), with_sums), every)).otherwise(F.array())


def literal(query: str) -> str:
    """A pattern that finds the query whatever its case."""
    return "(?iu)" + re.sub(r"([^\w\s]|_)", r"\\\1", query)


def search(text: Column, query: str | None = None, pattern: str | None = None, context: int = 80) -> Column:
    """Spans of a literal query (any case) or of a pattern (case counts). Bad arguments raise at once."""
    if (query is None) == (pattern is None):
        raise ValueError("give either a query or a pattern")
    if context < 0:
        raise ValueError("the context can't be negative")
    wanted = pattern if query is None else literal(query)
    if query == "":
        raise ValueError("an empty query matches everywhere")
    if pattern is not None:
        check_pattern(pattern)
    return spans(text, wanted, context)


#: Turns of repetitions that may be read in two ways, and endless repetitions side by side that may take the same
#: characters: beyond these a pattern is refused.
MOST_TURNS, MOST_SIDE_BY_SIDE = 8, 3
#: What only Java reads, as something of the same width that Python reads.
_JAVA_ONLY = ((r"\\Q(.*?)(?:\\E|\Z)", lambda m: re.escape(m[1])), (r"\\[pP](?:\{[^}]*\}|.)", r"\\w"), (r"\\[hH]", r"\\s"), (r"\\[RvVX]", r"\\s"), (r"\\z", r"\\Z"), (r"\(\?<([a-zA-Z])", r"(?P<\1"))


def _parsed(pattern: str):
    """The pattern as Python's parser sees it, None if it can't."""
    for given in (pattern, None):
        if given is None:
            given = pattern
            for java, python in _JAVA_ONLY:
                given = re.sub(java, python, given, flags=re.DOTALL)
        try:
            return _parser.parse(given)
        except (re.error, OverflowError, RecursionError):
            continue
    return None


def check_pattern(pattern: str) -> None:
    """Refuses patterns that don't compile, may match the empty text anywhere, or may take very long: repetitions,
    endless or not, whose turns a text can be dealt to in more than one way, or several endless ones side by side for
    the same characters. What can't be judged is refused as well; search_within takes such patterns under a deadline."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            empty = spark._jvm.java.util.regex.Pattern.compile(pattern).matcher("").find()
        else:
            empty = re.compile(pattern).search("") is not None
    except Exception as broken:
        raise ValueError(f"{pattern!r} is not a valid pattern: {broken}") from None
    parsed = _parsed(pattern)
    if parsed is None:
        raise ValueError(f"{pattern!r} can't be judged")
    if empty or parsed.getwidth()[0] == 0:
        raise ValueError(f"{pattern!r} may match the empty text")
    if _ambiguous(list(parsed)) or _side_by_side(list(parsed)) > MOST_SIDE_BY_SIDE:
        raise ValueError(f"{pattern!r} repeats what can match in several ways and may never end")


def search_within(text: Column, pattern: str, seconds: float = 2.0, context: int = 80) -> Column:
    """struct(spans, problem): what search finds, for patterns that check_pattern refuses. Each row has a deadline of its
    own; one that misses it has no spans but a problem (400), the others aren't harmed. Matches of no width count, once
    at each place. Null texts have neither. Patterns are read by the regex library; what it can't read raises at once."""
    import regex

    if context < 0 or seconds <= 0:
        raise ValueError("a context can't be negative, nor a deadline zero")
    try:
        regex.compile(pattern)
    except regex.error as broken:
        raise ValueError(f"{pattern!r} is not a valid pattern: {broken}") from None
    late = {"status": 400, "title": TITLES[400], "detail": f"the pattern took more than {seconds:g} s"}

    def one(value: str | None):
        if value is None:
            return None
        try:
            found = [(m[0], *m.span()) for m in regex.finditer(pattern, value, timeout=seconds)]
        except TimeoutError:
            return {"spans": None, "problem": late}
        return {"spans": [{"match": t, "start": a, "end": b, "context": value[max(0, a - context) : b + context]} for t, a, b in found], "problem": None}

    span = pa.struct([("match", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.string())])
    told = pa.struct([("spans", pa.list_(span)), ("problem", pa.struct([("status", pa.int32()), ("title", pa.string()), ("detail", pa.string())]))])

    @F.arrow_udf(f"spans array<struct<match: string, start: int, end: int, context: string>>, problem {PROBLEM}")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in texts.to_pylist()], told)

    return run(text)


# ---- whether a repetition is ambiguous, by the characters that may come first and next

_ANY = frozenset(range(257))  # 256 stands for all characters beyond
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)
_CLASSES = {op.CATEGORY_DIGIT: r"\d", op.CATEGORY_SPACE: r"\s", op.CATEGORY_WORD: r"\w"}


def _category(what) -> frozenset:
    for name, shorthand in _CLASSES.items():
        inside = frozenset(c for c in range(256) if re.match(shorthand, chr(c), re.ASCII))
        if what == name:
            return inside
        if str(what) == str(name).replace("CATEGORY_", "CATEGORY_NOT_"):
            return _ANY - inside
    return _ANY


def _char(code: int) -> frozenset:
    both = {ord(x) for x in (chr(code).lower(), chr(code).upper()) if len(x) == 1}
    return frozenset(min(c, 256) for c in both | {code})


def _set(items) -> frozenset:
    found: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found |= _char(value)
        elif kind is op.RANGE:
            found |= {min(c, 256) for c in range(value[0], min(value[1], 256) + 1)} | ({256} if value[1] > 255 else set())
        elif kind is op.CATEGORY:
            found |= _category(value)
    return _ANY - (found - {256}) if items and items[0][0] is op.NEGATE else frozenset(found)


def _first(items: list, after: frozenset) -> frozenset:
    """The characters that a sequence may begin with, if those of after follow it."""
    found: frozenset = frozenset()
    for kind, value in items:
        own, skipped = _begins(kind, value)
        found |= own
        if not skipped:
            return found
    return found | after


def _begins(kind, value) -> tuple[frozenset, bool]:
    """The characters that an item begins with, and whether it may match the empty text."""
    if kind is op.LITERAL:
        return _char(value), False
    if kind is op.NOT_LITERAL:
        return _ANY, False
    if kind is op.ANY:
        return _ANY, False
    if kind is op.IN:
        return _set(value), False
    if kind is op.BRANCH:
        parts = [_whole(list(b)) for b in value[1]]
        return frozenset().union(*(p[0] for p in parts)), any(p[1] for p in parts)
    if kind is op.SUBPATTERN:
        return _whole(list(value[3]))
    if kind is op.ATOMIC_GROUP:
        return _whole(list(value))
    if kind in _REPEATS:
        own, empty = _whole(list(value[2]))
        return own, empty or value[0] == 0
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return frozenset(), True
    return _ANY, True


def _whole(items: list) -> tuple[frozenset, bool]:
    mark = frozenset({-1})
    found = _first(items, mark)
    return found - mark, bool(found & mark)


def _ambiguous(items: list, times: int = 1) -> bool:
    """Whether some repetition in the sequence, of more than a few turns with those around it, has turns that overlap."""
    for kind, value in items:
        inner = {op.SUBPATTERN: lambda v: [list(v[3])], op.ATOMIC_GROUP: lambda v: [list(v)], op.BRANCH: lambda v: [list(b) for b in v[1]]}.get(kind, lambda v: [list(v[2])] if kind in _REPEATS else [])(value)
        turns = times * int(value[1]) if kind in _REPEATS else times
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] > 1 and turns > MOST_TURNS:
            body = list(value[2])
            if _overlaps(body, _whole(body)[0]):
                return True
        if any(_ambiguous(x, turns) for x in inner):
            return True
    return False


def _side_by_side(items: list) -> int:
    """The most endless repetitions in a row that may take the same characters, whatever lies between them may be too."""
    most, count, taken = 0, 0, frozenset()

    def walk(sequence: list) -> None:
        nonlocal most, count, taken
        for kind, value in sequence:
            if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] > 64:
                own = _whole(list(value[2]))[0]
                count = count + 1 if own & taken else 1
                taken, most = own, max(most, count)
            elif kind in _REPEATS:
                walk(list(value[2]))
            elif kind is op.SUBPATTERN:
                walk(list(value[3]))
            elif kind is op.ATOMIC_GROUP:
                walk(list(value))
            elif kind is op.BRANCH:
                begin, ends = (count, taken), []
                for branch in value[1]:
                    count, taken = begin
                    walk(list(branch))
                    ends.append((count, taken))
                count, taken = max(c for c, _ in ends), frozenset().union(*(t for _, t in ends))
            else:
                own, empty = _begins(kind, value)
                if not empty and not own & taken:
                    count, taken = 0, frozenset()

    walk(items)
    return most


def _overlaps(items: list, again: frozenset) -> bool:
    """Whether a sequence whose end may be followed by again can be read in two ways."""
    for k, (kind, value) in enumerate(items):
        after = _first(items[k + 1 :], again)
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] > value[0]:
            body = list(value[2])
            if _whole(body)[0] & after or (value[1] > 1 and _overlaps(body, _whole(body)[0] | after)):
                return True
        elif kind is op.BRANCH:
            starts = [_first(list(b), after) for b in value[1]]
            if any(a & b for i, a in enumerate(starts) for b in starts[:i]) or any(_overlaps(list(b), after) for b in value[1]):
                return True
        elif kind is op.SUBPATTERN and _overlaps(list(value[3]), after):
            return True
    return False
