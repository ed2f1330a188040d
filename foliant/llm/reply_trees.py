"""Chat formatting of reply trees.

Messages point to what they answer. Iterated self-joins that double their reach find each message's root and
the score of the path to it, then list the messages of the chosen paths: a tree of depth d takes log2(d) joins
each way. The branches of a tree are ranked by the mean score of their messages. A chosen path is written as one
conversation, in parts of bounded size, with the spans that a loss counts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, numbered
from foliant.llm.turns import TIE, arrow_schema, batches_of, ordered, rows_of, with_stretch

#: Characters of a part of a formatted conversation, unless a turn alone has more.
PART_CHARS = 1 << 20
ESCAPE = "\\"
#: Columns of formatted parts beside the tree's.
PARTS = "path long, part int, formatted string, loss array<struct<start: long, end: long>>"


@dataclass(frozen=True)
class Template:
    """Marks around a turn's role and text, and the strings that texts may not hold as they are.

    A mark's first character is in no mark again, so that none begins in a text and ends in a mark."""

    begin: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self) -> None:
        for x in self.controls:
            if len(x) < 2 or ESCAPE in x or x[0] in x[1:]:
                raise ValueError(f"{x!r} can't be told from what lies beside it")
        for x in (self.begin, self.middle, self.end):
            if not any(x.endswith(c) for c in self.controls) or re.sub("|".join(map(re.escape, self.controls)), "", x):
                raise ValueError(f"{x!r} isn't made of control strings")

    def escaped(self, text: Column) -> Column:
        """text whose escape signs are doubled and whose control strings have one behind their first character."""
        safe = lambda x: re.sub(r"([^A-Za-z0-9])", r"\\\1", x)
        inner = "|".join(f"(?<={safe(x[0])})(?={safe(x[1:])})" for x in self.controls)
        return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), inner, re.sub(r"([\\$])", r"\\\1", ESCAPE))

    def turn(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.begin)}(.*?){re.escape(self.middle)}(.*?){re.escape(self.end)}", re.DOTALL)


def plain(text: str) -> str:
    """What was escaped: of two escape signs one stays, one alone goes."""
    return re.sub(r"\\(\\?)", r"\1", text) if ESCAPE in text else text


def branch_paths(scratch: Scratch, links: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, path, nth, node) of the best branches of each tree, or of all if best is None.

    links(tree, node, up, score): node is unique, up the node that it answers, null for a root. A branch runs from a
    root to a node that none answers and is named by that node, its path. Branches rank by the mean score of their
    nodes (null counts as 0), equal ones by the smaller path. Nodes of a ring of answers, and what hangs from them,
    have no root and are in no branch."""
    t = scratch.save(links.selectExpr("tree", "node", "up", "coalesce(score, 0D) AS total", "1L AS size"), "up0")
    rows, steps = t.count(), [t]
    while not (open_ := t.where("up IS NOT NULL")).isEmpty() and 1 << (len(steps) - 1) <= rows:
        above = t.selectExpr("node AS up", "up AS next", "total AS more", "size AS longer")
        further = open_.join(above, "up").selectExpr("tree", "node", "next AS up", "total + more AS total", "size + longer AS size")
        t = scratch.save(t.where("up IS NULL").select("tree", "node", "up", "total", "size").union(further), f"up{len(steps)}")
        steps.append(t)
    ends = t.where("up IS NULL").join(steps[0].where("up IS NOT NULL").selectExpr("up AS node").distinct(), "node", "left_anti")
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("size")), "node"))
        ends = ends.withColumn("rank", rank).where(F.col("rank") <= best)
    found = scratch.save(ends.selectExpr("tree", "node AS path", "size - 1 AS nth", "node"), "path0")
    for k, step in enumerate(steps[:-1]):  # what lies 2^k answers above
        jumps = step.where("up IS NOT NULL").select("node", "up")
        more = found.join(jumps, "node").select("tree", "path", (F.col("nth") - (1 << k)).alias("nth"), F.col("up").alias("node"))
        found = scratch.save(found.union(more), f"path{k + 1}")
        scratch.drop(f"path{k}")
    for k in range(len(steps)):
        scratch.drop(f"up{k}")
    return found


def format_paths(paths: DataFrame, messages: DataFrame, template: Template, trained: str = "assistant") -> DataFrame:
    """Parts (tree, PARTS) of the conversations of paths(tree, path, nth, node), whose messages(node, role, text) hold
    what is said. loss has the spans of the part, in code points, that hold the texts of the trained role. A part ends
    with a turn; most conversations have one. Null roles and texts count as empty."""
    kind = paths.schema["tree"].dataType.simpleString()
    said = messages.select("node", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    said = said.select("node", (F.col("role") == trained).alias("loss"), *[template.escaped(F.col(c)).alias(c) for c in ("role", "text")])
    rows = paths.join(said, "node").select("tree", "path", "nth", "loss", "role", "text")
    rows = rows.repartition("tree", "path").sortWithinPartitions("tree", "path", "nth")
    begin, middle, end = template.begin, template.middle, template.end

    def parts(batches):
        for (tree, path), turns in groupby(rows_of(batches), key=lambda r: r[:2]):
            part, pieces, size, loss = 0, [], 0, []
            for _, _, _, counts, role, text in turns:
                head = f"{begin}{role}{middle}"
                if pieces and size + len(head) + len(text) + len(end) > PART_CHARS:
                    yield tree, path, part, "".join(pieces), loss
                    part, pieces, size, loss = part + 1, [], 0, []
                at = size + len(head)
                if counts:
                    loss.append({"start": at, "end": at + len(text)})
                pieces += [head, text, end]
                size = at + len(text) + len(end)
            yield tree, path, part, "".join(pieces), loss

    given = arrow_schema(paths.schema["tree"], PARTS)
    return rows.mapInArrow(lambda batches: batches_of(parts(batches), given, text=3), f"tree {kind}, {PARTS}")


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parts: DataFrame, template: Template) -> DataFrame:
    """(tree, path, DIGESTS) read back from formatted parts: turns by the template's marks, and what the loss counts
    by the spans, both without escapes. The parts of a conversation pass one after the other; none is kept."""
    kind = parts.schema["tree"].dataType.simpleString()
    rows = parts.repartition("tree", "path").sortWithinPartitions("tree", "path", "part").select("tree", "path", "formatted", "loss")
    turn = template.turn()

    def read(batches):
        for (tree, path), told in groupby(rows_of(batches), key=lambda r: r[:2]):
            turns, counted, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, formatted, loss in told:
                at = 0
                while at < len(formatted):
                    found = turn.match(formatted, at)
                    if found is None:
                        raise ValueError(f"no turn begins at character {at} of conversation {tree}")
                    turns.update(f"{plain(found[1])}\n{plain(found[2])}\n".encode())
                    n, at = n + 1, found.end()
                for span in loss:
                    text = plain(formatted[span["start"] : span["end"]])
                    counted.update(text.encode())
                    loss_chars += len(text)
                chars += len(formatted)
            yield tree, path, n, turns.hexdigest(), loss_chars, counted.hexdigest(), chars

    given = arrow_schema(parts.schema["tree"], f"path long, {DIGESTS}")
    return rows.mapInArrow(lambda batches: batches_of(read(batches), given), f"tree {kind}, path long, {DIGESTS}")


def format_trees(spark: SparkSession, messages: DataFrame, tree: str, message: str, parent: str, role: str, text: str, score: str | None = None, best: int | None = 1, template: Template = Template()) -> DataFrame:
    """Parts (tree, PARTS) of the best branches of each tree of messages, or of all if best is None.

    A message without a parent, or with one that its tree hasn't got, begins a tree's branches; a null tree is a tree
    of its own. Of rows that repeat a message's id those that answer it answer the first one; the others end
    branches of their own. Null scores count as 0, null roles and texts as empty; texts of any length stay whole; an
    empty table gives no part. Other columns are left out, whatever their names."""
    scratch = Scratch(spark)
    worth = F.col(score).cast("double") if score else F.lit(0.0)
    named = [F.col(tree).alias("tree"), F.col(message).alias("message"), F.col(parent).alias("parent"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), worth.alias("score")]
    rows = numbered(scratch, messages.select(*named), "messages")
    known = scratch.save(rows.where("message IS NOT NULL").groupBy("tree", "message").agg(F.min("node").alias("up")), "known").withColumnsRenamed({"tree": "of", "message": "name"})
    answers = rows.where("parent IS NOT NULL").select("tree", "node", "score", "parent")
    up = answers.join(known, answers["tree"].eqNullSafe(known["of"]) & (F.col("parent") == F.col("name")), "left")
    links = up.select("tree", "node", "up", "score").union(rows.where("parent IS NULL").select("tree", "node", F.lit(None).cast("long"), "score"))
    return format_paths(branch_paths(scratch, links, best), rows.select("node", "role", "text"), template)


def format_conversations(spark: SparkSession, conversations: DataFrame, template: Template = Template(), scratch: Scratch | None = None) -> DataFrame:
    """Parts (tree, PARTS) of conversations(conv_id, turn, role, text): each turn answers the one before it.

    Rows go by turn, nulls first, those of one turn by role and text; repeated rows are turns of their own. A null
    conv_id is a conversation of its own. Null roles and texts count as empty; texts of any length stay whole; an empty
    table gives no part. Other columns are left out, whatever their names. scratch may be given by who drops its table
    of turns when the parts are stored."""
    scratch = scratch or Scratch(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    kept = ordered(scratch, rows.withColumn("tie", F.substring("text", 1, TIE)), "turns", "text")
    up = F.when(F.col("place") > F.col("first"), F.col("place") - 1).otherwise(F.col("behind"))
    links = with_stretch(kept.select("conv", "place")).select(F.col("conv").alias("tree"), F.col("place").alias("node"), up.alias("up"), F.lit(0.0).alias("score"))
    return format_paths(branch_paths(scratch, links), kept.select(F.col("place").alias("node"), "role", "text"), template)


#: A conversation whose texts hold what the template is made of.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def conversation_digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id and DIGESTS of all conversations and TRICKY, formatted, written to the shared folder and read back."""
    template = Template()
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    rows = conversations.select(*columns).union(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string"))
    scratch = Scratch(spark)
    parts = scratch.save(format_conversations(spark, rows, template, scratch), "formatted")
    scratch.drop("turns")
    return digests(parts, template).select(F.col("tree").alias("conv_id"), *[x.split()[0] for x in DIGESTS.split(", ")])


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, role = 'assistant' AS said,
  regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS r,
  regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN said THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN said THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length('<s>[INST]') + length(r) + length('[/INST]') + length(t) + length('</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
