"""Repair of the structure of conversations by weighted finite-state composition.

A conversation is an acceptor of its rows, an edit transducer keeps, renames, deletes or inserts them at a price, and
an acceptor of role initials says what is well formed. Their composition is made arc by arc as rows call for it; its
states are a row and a state of the grammar. Prices to the end are relaxed in reverse topological order. The arcs
that leave a state differ in their labels, so that the least label among the cheapest arcs begins the least of the
cheapest strings; what is kept for each row is one label for each state of the grammar, in a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch
from foliant.llm.turns import TIE, arrow_schema, batches_of, crc32_sql, ordered, rows_of

#: Labels of the edits in ASCII order, and what each costs; a truncated row that isn't deleted costs one more.
LABELS = "DIKR"
DELETE, INSERT, KEEP, RENAME = range(4)
COST = (3, 2, 0, 2)
TRUNCATED_COST = 1
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = {"u": "user", "a": "assistant"}
NONE = 1 << 60
ROLE_PAIRS = frozenset(["su", "ua", "au"])


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of role initials: arcs[state][initial] is the next state. Of the initials in NAMES,
    which edits can make, each state has one at most; there are four states at most."""

    arcs: tuple[dict[str, int], ...]
    ends: frozenset[int]

    def __post_init__(self) -> None:
        if len(self.arcs) > 4 or any(len(a.keys() & NAMES.keys()) > 1 for a in self.arcs):
            raise ValueError("four states at most, each with one arc at most for the initials that edits make")

    def made(self, state: int) -> tuple[str, int] | None:
        """The initial that an edit can make in a state, and where it leads."""
        return next(((x, to) for x, to in self.arcs[state].items() if x in NAMES), None)


#: (s?(ua)+)?
SYSTEM_THEN_PAIRS = Grammar(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), frozenset([0, 3]))


class Composition:
    """Rows o edits o grammar. Arcs of a row's symbol are composed when it is first met."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar, self.states = grammar, range(len(grammar.arcs))
        self.composed: dict[tuple[str, int], list[list[tuple[int, int, int]]]] = {}
        self.inserts = [(q, made[1]) for q in self.states if (made := grammar.made(q))]

    def arcs(self, symbol: tuple[str, int]) -> list[list[tuple[int, int, int]]]:
        """For each state the arcs (label, price, next state) that consume a row of this initial and fault."""
        found = self.composed.get(symbol)
        if found is None:
            found = self.composed[symbol] = [list(self._arcs(q, *symbol)) for q in self.states]
        return found

    def _arcs(self, q: int, initial: str, fault: int) -> Iterator[tuple[int, int, int]]:
        yield DELETE, COST[DELETE], q
        if fault in (BLANK, DUPLICATE):
            return
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if initial in self.grammar.arcs[q]:
            yield KEEP, COST[KEEP] + more, self.grammar.arcs[q][initial]
        if made := self.grammar.made(q):
            yield RENAME, COST[RENAME] + more, made[1]

    def _inserted(self, cost: list[int], label: list[int]) -> None:
        """Arcs that consume nothing: a string of them never visits a state twice, since each has a price."""
        for _ in self.states:
            for q, to in self.inserts:
                price = cost[to] + COST[INSERT]
                if price < cost[q] or price == cost[q] and label[q] > INSERT:
                    cost[q], label[q] = price, INSERT

    def start(self) -> tuple[list[int], int]:
        """Prices behind the last row, and the byte of the labels there; KEEP stands for the end."""
        cost = [0 if q in self.grammar.ends else NONE for q in self.states]
        label = [KEEP] * len(cost)
        for q in self.states:
            if cost[q] == NONE:
                label[q] = RENAME
        # an accepting state ends: any insertion has a price
        self._inserted(cost, label)
        return cost, _byte(label)

    def before(self, symbol: tuple[str, int], behind: list[int]) -> tuple[list[int], int]:
        """Prices in front of a row from those behind it, and the byte of its labels."""
        cost, label = [], []
        for arcs in self.arcs(symbol):
            least, best = min((behind[to] + price, name) for name, price, to in arcs)
            cost.append(least)
            label.append(best)
        self._inserted(cost, label)
        return cost, _byte(label)

    def walk(self, labels: bytes, symbols_kept: Callable[[int], str]) -> str:
        """The cheapest edits' labels; labels has a byte for each row and one for the end, symbols_kept tells a
        row's initial."""
        out, q = [], 0
        for i, byte in enumerate(labels):
            while True:
                label = byte >> 2 * q & 3
                if i == len(labels) - 1 and label != INSERT:
                    break
                out.append(LABELS[label])
                if label in (INSERT, RENAME):
                    q = self.grammar.made(q)[1]
                elif label == KEEP:
                    q = self.grammar.arcs[q][symbols_kept(i)]
                if label != INSERT:
                    break
        return "".join(out)


def _byte(labels: list[int]) -> int:
    return sum(x << 2 * q for q, x in enumerate(labels))


def repaired(grammar: Grammar, audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave; an inserted row has no text."""
    left, q = iter(rows), 0
    for label in audit:
        role, text = (None, "") if label == "I" else next(left)
        if label == "D":
            continue
        if label == "K":
            q = grammar.arcs[q][role[:1]]
        else:
            initial, q = grammar.made(q)
            role = NAMES[initial]
        yield role, text


AUDITS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audited(grammar: Grammar, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, AUDITS) of rows (conv, turn, initial, fault) that come from each conversation's last to its first."""
    machine = Composition(grammar)
    for conv, rows in groupby(rows_of(batches), key=lambda r: r[0]):
        cost, byte = machine.start()
        labels, initials, counts, illegal = bytearray([byte]), [], [0] * 4, 0
        high = low = before = None
        turns, behind = 0, None
        for _, turn, initial, fault in rows:
            if turn is not None:
                turns += turn != before
                high, low, before = turn if high is None else high, turn, turn
            if behind is not None:
                illegal += initial + behind not in ROLE_PAIRS
            behind = initial
            initials.append(initial)
            counts[fault] += 1
            cost, byte = machine.before((initial, fault), cost)
            labels.append(byte)
        labels.reverse()
        audit = machine.walk(bytes(labels), lambda i, n=len(initials), kept=initials: kept[n - 1 - i])
        yield conv, 0 if high is None else high - low + 1 - turns, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost[0], audit


def own_fault(text: Column) -> Column:
    """The fault that a text shows by itself."""
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    cut = text.rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")
    return F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(SOUND)


def damage(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults put in by crc32 of "conv_id:turn" mod 20: 0 drops a row, 1
    empties its text, 2 takes ".", "!" and "?" out of it, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("copy")


def repair(spark: SparkSession, conversations: DataFrame, grammar: Grammar = SYSTEM_THEN_PAIRS, with_rows: bool = False) -> DataFrame:
    """conv_id, AUDITS and repaired_sha256 of conversations(conv_id, turn, role, text); if with_rows is set instead
    the repaired rows (conv_id, nth, role, text).

    Rows go by turn, nulls first, those of one turn by role and text. Nulls in role and text count as one space; an
    initial is a role's first character, whatever the role; a null conv_id is a conversation of its own; a text of any
    length stays whole; an empty table gives no row. Other columns are left out, whatever their names. Repeated texts
    are found by 128-bit hashes in an aggregate. Of a conversation a task holds an initial and a byte for each row,
    like the audit that it returns; texts pass one after the other."""
    scratch = Scratch(spark)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"))
    rows = rows.withColumns({"tie": F.substring("text", 1, TIE), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(1), "role")})
    kept = ordered(scratch, rows, "rows", "text")
    repeats = kept.groupBy("conv", "h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = scratch.save(repeats.selectExpr("conv AS of", "h1 AS g1", "h2 AS g2", "first"), "repeats")
    narrow = scratch.save(kept.select("conv", "turn", "place", "h1", "h2", F.substring("role", 1, 1).alias("initial"), own_fault(F.col("text")).alias("own")), "narrow")
    same = narrow["conv"].eqNullSafe(repeats["of"]) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    fault = F.when((F.col("own") != BLANK) & (F.col("place") > F.col("first")), DUPLICATE).otherwise(F.col("own"))
    marked = narrow.join(repeats, same, "left").select("conv", "place", "turn", "initial", fault.cast("int").alias("fault"))
    back = marked.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("place")).select("conv", "turn", "initial", "fault")
    of = kept.schema["conv"]
    given = arrow_schema(of, AUDITS)
    audits = scratch.save(back.mapInArrow(lambda b: batches_of(_audited(grammar, b), given, text=7), f"conv long, {AUDITS}"), "audits")
    names = [x.split()[0] for x in AUDITS.split(", ")]
    # an audit comes before the rows of its conversation
    lead = audits.select("conv", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), *names)
    both = lead.union(kept.select("conv", "place", "role", "text", *[F.lit(None).cast(audits.schema[c].dataType) for c in names]))
    both = both.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "place")

    def told(batches):
        for conv, all_ in groupby(rows_of(batches), key=lambda r: r[0]):
            first = next(all_)
            left = repaired(grammar, first[-1], (r[2:4] for r in all_))
            if with_rows:
                yield from ((conv, n, *x) for n, x in enumerate(left))
                continue
            digest = hashlib.sha256()
            for n, (role, text) in enumerate(left):
                digest.update(f"{'\n' if n else ''}{role}:{text}".encode())
            for _ in all_:
                pass
            yield conv, *first[4:], digest.hexdigest()

    rest = "nth long, role string, text string" if with_rows else f"{AUDITS}, repaired_sha256 string"
    shape = arrow_schema(of, rest)
    return both.mapInArrow(lambda b: batches_of(told(b), shape, text=3 if with_rows else None), f"conv long, {rest}").withColumnRenamed("conv", "conv_id")


def damage_and_repair(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """What repair tells of damaged conversations, for each conv_id there was; zeros, an empty audit and the hash of
    nothing for one of which no row is left."""
    names = [*(x.split()[0] for x in AUDITS.split(", ")), "repaired_sha256"]
    found = repair(spark, damage(conversations)).withColumnRenamed("conv_id", "of")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.join(found, every["conv_id"].eqNullSafe(found["of"]), "left").select("conv_id", *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in names])


def _edits(q: int, state: dict[str, int]) -> str:
    """SQL for the cheapest of a row's edits in a state of the grammar; b0 to b3 are (cost, audit, rows) behind the row."""
    free, late = f"fault IN ({SOUND}, {TRUNCATED})", f"CASE WHEN fault = {TRUNCATED} THEN {TRUNCATED_COST} ELSE 0 END"
    found = [f"{{'c': b{q}.c + {COST[DELETE]}, 's': 'D' || b{q}.s, 't': b{q}.t}}"]
    for initial, to in state.items():
        found.append(f"CASE WHEN {free} AND initial = '{initial}' THEN {{'c': b{to}.c + {late}, 's': 'K' || b{to}.s, 't': chr(10) || role || ':' || text || b{to}.t}} END")
        if initial in NAMES:
            found.append(f"CASE WHEN {free} THEN {{'c': b{to}.c + {COST[RENAME]} + {late}, 's': 'R' || b{to}.s, 't': chr(10) || '{NAMES[initial]}:' || text || b{to}.t}} END")
    return f"list_min(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)) AS p{q}"


def _insert(into: str, behind: str, role: str) -> str:
    return f"list_min([{into}, {{'c': {behind}.c + {COST[INSERT]}, 's': 'I' || {behind}.s, 't': chr(10) || '{role}:' || {behind}.t}}])"


ORACLE = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS code FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE code <> 0),
o AS (SELECT *, row_number() OVER w AS i, left(lag(role) OVER w, 1) || left(role, 1) AS pair,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT conv_id, turn, i, role, text, pair, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN {BLANK}
  WHEN again THEN {DUPLICATE} WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN {TRUNCATED} ELSE {SOUND} END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank,
  count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
b AS (SELECT conv_id, n + 1 AS i, {{'c': 0, 's': '', 't': ''}} AS b0, {{'c': 4, 's': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS b1,
  {{'c': 2, 's': 'I', 't': chr(10) || 'assistant:'}} AS b2, {{'c': 0, 's': '', 't': ''}} AS b3 FROM n
  UNION ALL
  SELECT conv_id, i, {_insert("p0", "q2", "user")}, {_insert("p1", "q2", "user")}, q2, q3 FROM (
    SELECT conv_id, i, p0, p1, {_insert("p2", "p3", "assistant")} AS q2, {_insert("p3", "p2", "user")} AS q3 FROM (
      SELECT f.conv_id, f.i, {", ".join(_edits(q, state) for q, state in enumerate(SYSTEM_THEN_PAIRS.arcs))}
      FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b0.c, 0)::BIGINT AS cost, coalesce(b0.s, '') AS audit, sha256(coalesce(substr(b0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 1"""
