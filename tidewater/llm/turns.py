"""Repair the structure of conversations by the cheapest edits.

The turns of a conversation and the states of a grammar span a lattice: a node is
(turns read, state), an edge an edit of the next turn or an inserted turn.  It is
never built; Dijkstra's search grows it from a heap whose key is the pair of cost
and audit, the edits' initials so far, and ends at the first node taken from the
heap that has read all turns in an accepting state.  As an audit only grows by
letters behind, the first such node has the least cost and among those the least
audit.

A conversation is one shuffle key and passes its task as a stream: repaired texts
are hashed in order, which can't be shared out.  A long one is searched in blocks
of ``BLOCK_TURNS``.  A block is entered from up to four states, with the cost, the
audit and the running hash of the cheapest path to each, so memory holds one block
of texts and a letter a turn, however long the conversation.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_TURNS = 128
#: Conversations in one Arrow batch of results.
BATCH = 1000
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1

_BLANKS = " \t\n\x0b\f\r"
# States: nothing yet, after the system's turn, after a user's turn, after an assistant's turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ACCEPTING = (_START, _ASSISTANT)
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The role that an inserted or renamed turn has to have in each state, and the state after it.
_FORCED = {_START: ("user", _USER), _SYSTEM: ("user", _USER), _USER: ("assistant", _ASSISTANT), _ASSISTANT: ("user", _USER)}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

#: The order of a conversation's rows, nulls first.
_ORDER = ("turn", "role", "text", "seen", "copy")
_REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]


@dataclass
class Turn:
    role: str
    text: str
    fault: str | None


@dataclass
class Path:
    """The cheapest way to a state: its cost, the audit since the last common one, and the hash of what it has written."""

    cost: int = 0
    audit: str = ""
    digest: Any = field(default_factory=hashlib.sha256)
    wrote: bool = False

    def after(self, cost: int, audit: str, state: int, turns: list[Turn]) -> Path:
        """This path, entered in ``state`` and led on through ``turns`` to ``audit``."""
        out = Path(cost, audit, self.digest.copy(), self.wrote)
        for role, text in replay(audit[len(self.audit) :], state, turns):
            out.digest.update((b"\n" if out.wrote else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            out.wrote = True
        return out


def replay(edits: str, state: int, turns: list[Turn]) -> Iterator[tuple[str, str]]:
    """The turns that ``edits`` make of ``turns``, as (role, text)."""
    i = 0
    for edit in edits:
        role, after = _FORCED[state]
        if edit == "K":
            role, after = turns[i].role, _NEXT[state, turns[i].role[:1]]
        if edit != "D":
            yield role, "" if edit == "I" else turns[i].text
            state = after
        i += edit != "I"


def cheapest(entries: dict[int, Path], turns: list[Turn], last: bool) -> dict[int, Path]:
    """The best path through ``turns`` to each state, or to the best accepting one only if they are the ``last``."""
    heap = [(p.cost, p.audit, 0, s, s) for s, p in entries.items()]
    heapq.heapify(heap)
    settled: set[tuple[int, int]] = set()
    exits: dict[int, Path] = {}
    while heap:
        cost, audit, i, state, entry = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == len(turns):
            if not last:
                exits[state] = entries[entry].after(cost, audit, entry, turns)
            elif state in _ACCEPTING:
                return {state: entries[entry].after(cost, audit, entry, turns)}
        forced = _FORCED[state][1]
        steps = [(INSERT, "I", i, forced)]
        if i < len(turns):
            turn = turns[i]
            steps.append((DELETE, "D", i + 1, state))
            if turn.fault not in ("blank", "duplicate"):
                more = TRUNCATED if turn.fault == "truncated" else 0
                steps.append((REROLE + more, "R", i + 1, forced))
                if (state, turn.role[:1]) in _NEXT:
                    steps.append((KEEP + more, "K", i + 1, _NEXT[state, turn.role[:1]]))
        for more, edit, j, after in steps:
            if (j, after) not in settled:
                heapq.heappush(heap, (cost + more, audit + edit, j, after, entry))
    return exits


class Conversation:
    """One conversation as it streams by."""

    def __init__(self) -> None:
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.first = self.turn = self.initial = None
        self.paths, self.block, self.audit = {_START: Path()}, [], []

    def add(self, turn: int | None, row: Turn) -> None:
        if len(self.block) == BLOCK_TURNS:
            self._step(False)
        if turn is not None and turn != self.turn:
            self.distinct, self.turn = self.distinct + 1, turn
            self.first = turn if self.first is None else self.first
        if row.fault:
            self.counts[row.fault] += 1
        self.illegal += self.initial is not None and (self.initial, row.role[:1]) not in _LEGAL
        self.initial = row.role[:1]
        self.block.append(row)

    def _step(self, last: bool) -> None:
        self.paths, self.block = cheapest(self.paths, self.block, last), []
        common = len(os.path.commonprefix([p.audit for p in self.paths.values()]))
        self.audit.append(next(iter(self.paths.values())).audit[:common])
        for p in self.paths.values():
            p.audit = p.audit[common:]

    def report(self) -> tuple:
        self._step(True)
        (path,) = self.paths.values()
        gaps = 0 if self.turn is None else min(self.turn - self.first + 1 - self.distinct, 2**63 - 1)
        return gaps, *self.counts.values(), self.illegal, path.cost, "".join(self.audit), path.digest.hexdigest()


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped, copy): the rows after a damage that the CRC of ``conv:turn`` chooses.

    Of twenty remainders 0 drops a row (it stays as a mark, so that its
    conversation is not lost), 1 empties its text, 2 takes its ``.!?`` away, 3
    repeats it and 4 makes it the user's.  Nulls in roles, texts and the CRC's
    input read as one space.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), kind.alias("kind"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind")


def whole(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as they are, in the form of :func:`damage`."""
    rows = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col)]
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), rows[0].alias("role"), rows[1].alias("text"), F.lit(False).alias("dropped"), F.lit(0).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`damage` with the first ``fault`` of each: blank, duplicate, truncated or null; laid out by conversation."""
    rows = rows.repartition(F.col("conv"))
    seen = F.row_number().over(Window.partitionBy("conv", "dropped", "role", "text").orderBy("turn", "copy")) > 1
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = F.when(trimmed == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("seen", seen).withColumn("fault", fault)


def repair(rows: DataFrame, conv_name: str = "conv_id") -> DataFrame:
    """A report for every conversation of ``rows``, which come from :func:`damage` or :func:`whole`.

    Keeping a turn costs 0, renaming its role to user or assistant 2, deleting it 3
    (blank and duplicate ones have to go), inserting an empty turn 2; a truncated
    turn that stays adds 1.  What is left must read ``(s?(ua)+)?`` in the roles'
    initials.  Columns: the conversation, ``gaps`` in its numbers, counts of
    first faults, ``illegal`` neighbours, the ``cost``, the ``audit`` and the
    hash of the repaired ``role:text`` lines.

    Defined cases: a null conversation is one as well; null turns come first;
    turns of one number are ordered by role and text; roles of other initials, or
    none, can't be kept; repeated rows are duplicates; a conversation without rows
    has zeros, an empty audit and the hash of nothing; an empty table gives an
    empty table; other columns were left behind, whatever their names; texts may
    be of any length, conversations of any number of turns.
    """
    kind = rows.schema["conv"].dataType
    laid = faults(rows).sortWithinPartitions("conv", *_ORDER).select("conv", "turn", "role", "text", "dropped", "fault")
    schema = T.StructType([T.StructField(conv_name, kind)] + [T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in _REPORT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        name, now, arrow = None, None, None

        def made() -> pa.RecordBatch:
            columns = list(zip(*found))
            kinds = [arrow] + [pa.int64() if t == "long" else pa.string() for _, t in _REPORT]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)
            found.clear()
            return out

        for batch in batches:
            arrow = batch.column("conv").type
            for conv, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != name:
                    if now is not None:
                        found.append((name, *now.report()))
                    if len(found) >= BATCH:
                        yield made()
                    name, now = conv, Conversation()
                if not dropped:
                    now.add(turn, Turn(role, text, fault))
        if now is not None:
            found.append((name, *now.report()))
            yield made()

    return laid.mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, reports: DataFrame, conv_name: str = "conv_id") -> DataFrame:
    """(conversation, ``position`` from 1, ``edit``, ``role``, ``text``): the turns that remain when the audits of ``reports`` are carried out."""
    order = Window.partitionBy("conv").orderBy(*_ORDER)
    numbered = faults(rows).filter("NOT dropped").select("conv", F.row_number().over(order).alias("row"), F.col("role").alias("own"), "text")
    letters = reports.filter("audit <> ''").select(F.col(conv_name).alias("c"), F.posexplode(F.split("audit", "")).alias("at", "edit")).filter("edit <> ''")
    by = Window.partitionBy("c").orderBy("at")
    letters = letters.withColumn("row", F.when(F.col("edit") != "I", F.sum(F.when(F.col("edit") != "I", 1).otherwise(0)).over(by)))
    made = letters.join(numbered, F.col("c").eqNullSafe(F.col("conv")) & (letters["row"] == numbered["row"]), "left").filter("edit <> 'D'")
    made = made.withColumn("position", F.row_number().over(by)).withColumn("system", F.first(F.when(F.col("edit") == "K", F.col("own").startswith("s")).otherwise(False)).over(by).cast("int"))
    role = F.when(F.col("edit") == "K", F.col("own")).when((F.col("position") - F.col("system")) % 2 == 1, "user").otherwise("assistant")
    return made.select(F.col("c").alias(conv_name), "position", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _oracle_sql() -> str:
    """The same over DuckDB's tables: CRC by table, and the best path to each state turn by turn instead of a search.

    A path is written as ten digits of cost and its audit, so the least text is the best path.
    """

    def grown(path: str, cost: str, edit: str) -> str:
        return f"printf('%010d', substr({path}, 1, 10)::BIGINT + {cost}) || substr({path}, 11) || '{edit}'"

    stay = "NOT r.gone"
    named = {i: f"r.initial = '{i}' AND {stay}" for i in "sua"}
    keep = {i: lambda p, i=i: f"CASE WHEN {named[i]} THEN {grown(p, 'r.more', 'K')} END" for i in "sua"}
    rename = lambda p: f"CASE WHEN {stay} THEN {grown(p, '2 + r.more', 'R')} END"
    delete = lambda p: grown(p, "3", "D")
    to_user = ", ".join([delete("p2")] + [f(p) for p in ("p0", "p1", "p3") for f in (keep["u"], rename)])
    to_assistant = ", ".join([delete("p3"), keep["a"]("p2"), rename("p2")])
    inserted = ", ".join(grown(q, "2", "I") for q in ("q0", "q1", "q3"))
    return rf"""
WITH RECURSIVE crc(n, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
), bytes AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
raw AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)) AS key
  FROM conversations
), kinds AS (
  SELECT conv, turn, role, text, xor(list_reduce(key, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM raw, bytes
), convs AS (SELECT DISTINCT conv FROM kinds),
damaged AS (
  SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM damaged
), marked AS (
  SELECT conv, turn, role, text, left(role, 1) AS initial,
         CASE WHEN shown = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, seen, copy) AS i
  FROM seen
), turns AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS more, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM marked
), facts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv
), walk(conv, i, p0, p1, p2, p3) AS (
  SELECT conv, 0::BIGINT, '0000000000', NULL::VARCHAR, '0000000002I', '0000000004II' FROM convs
  UNION ALL
  SELECT conv, i, q0, q1, m2, least(q3, {grown("m2", "2", "I")}) FROM (
    SELECT conv, i, q0, q1, q3, least(q2, {inserted}) AS m2 FROM (
      SELECT r.conv, r.i, {delete("p0")} AS q0, least({delete("p1")}, {keep["s"]("p0")}) AS q1, least({to_user}) AS q2, least({to_assistant}) AS q3
      FROM walk JOIN turns r ON r.conv IS NOT DISTINCT FROM walk.conv AND r.i = walk.i + 1
    )
  )
), best AS (
  SELECT w.conv, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, substr(least(p0, p3), 1, 10)::BIGINT AS cost, substr(least(p0, p3), 11) AS audit
  FROM walk w LEFT JOIN facts f ON f.conv IS NOT DISTINCT FROM w.conv WHERE w.i = coalesce(f.n, 0)
), letters AS (
  SELECT conv, edit, pos, sum((edit <> 'I')::INT) OVER (PARTITION BY conv ORDER BY pos) AS i
  FROM (SELECT conv, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM best WHERE audit <> '')
), kept AS (
  SELECT l.conv, l.edit, l.pos, t.role, CASE WHEN l.edit = 'I' THEN '' ELSE t.text END AS text, row_number() OVER (PARTITION BY l.conv ORDER BY l.pos) AS place
  FROM letters l LEFT JOIN turns t ON t.conv IS NOT DISTINCT FROM l.conv AND t.i = l.i AND l.edit <> 'I' WHERE l.edit <> 'D'
), roles AS (
  SELECT *, coalesce(first_value(edit = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv ORDER BY pos), false)::INT AS system FROM kept
), lines AS (
  SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS line FROM roles GROUP BY conv
)
SELECT b.conv AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(line, '')) AS repaired_sha256
FROM best b LEFT JOIN lines l ON l.conv IS NOT DISTINCT FROM b.conv
"""


ORACLE_SQL = _oracle_sql()
