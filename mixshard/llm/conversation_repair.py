"""Conversation repair by weighted CYK interval parsing (operator 11).

The rows of a conversation are the terminals of a repair grammar for ``(s?(ua)+)?``. Its
nonterminals ``N[p,q]`` stand for rows and insertions that take a reader of role initials
from state p to state q; the rules, in Chomsky normal form, are ``N[p,r] -> N[p,q] N[q,r]``
and ``N[p,q] -> row`` (kept, given another role, deleted). A span's cell keeps the least
(cost, audit) of every nonterminal, closed under insertions, and spans are combined bottom
up by their length: two of one length give one of twice the length. As the rules hold for
every pair of states, one split of a span is enough, so a long conversation costs
n log n and not n cubed, and its pieces can be parsed in different tasks.

Two audits of one span and cost are never prefixes of one another (both name every row, so
the longer would hold more insertions and cost more): the order of audits survives
concatenation, and a cell needs one audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm.columns import small
from mixshard.session import cut, prepare_session

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the reader: start, after s, after u, after a. Where each initial leads.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
ENDS = (0, 3)
#: Spans of up to this many rows are remembered by their row classes.
MEMO_ROWS = 8

_WHITE = " \t\n\x0b\x0c\r"  # fixed values: \x20\x09-\x0D
_ROLES = {"u": "user", "a": "assistant"}
Cell = dict[tuple[int, int], tuple[int, str]]


def joined(a: Cell, b: Cell) -> Cell:
    """The rules N[p,r] -> N[p,q] N[q,r] at one split."""
    out: Cell = {}
    for (p, q), (c, x) in a.items():
        for r in STATES:
            right = b.get((q, r))
            if right is not None and (best := (c + right[0], x + right[1])) < out.get((p, r), (1 << 62, "")):
                out[p, r] = best
    return out


def _insertions() -> Cell:
    """Cheapest insertions between every two states (none from a state to itself)."""
    cell: Cell = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, q), (c, x) in list(cell.items()):
            for i in "ua":
                r = STEPS.get((q, i))
                if r is not None and (c + INSERT, x + "I") < cell.get((p, r), (1 << 62, "")):
                    cell[p, r] = (c + INSERT, x + "I")
    return cell


EMPTY = _insertions()


@lru_cache(maxsize=None)  # three initials and another, three classes: twelve cells
def row_cell(initial: str, fault: str) -> Cell:
    """Cell of one row: ``fault`` is ``x`` (must go), ``t`` (truncated) or ``o``."""
    own: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if fault != "x":
        extra = TRUNCATED if fault == "t" else 0
        for edit, cost, initials in (("K", 0, initial), ("R", REROLE, "ua")):
            for i in initials:
                for p in STATES:
                    q = STEPS.get((p, i))
                    if q is not None:
                        own[p, q] = min((cost + extra, edit), own.get((p, q), (1 << 62, "")))
    return joined(joined(EMPTY, own), EMPTY)


@lru_cache(maxsize=1 << 14)
def _short_span(codes: tuple[str, ...]) -> Cell:
    if len(codes) == 1:
        return row_cell(codes[0][0], codes[0][1])
    half = 1 << (len(codes) - 1).bit_length() - 1
    return joined(_short_span(codes[:half]), _short_span(codes[half:]))


class Spans:
    """Cells of a growing run of rows: at most one open span of every length, so memory is
    that of the audits; equal lengths are combined as soon as there are two."""

    def __init__(self):
        self.open: list[tuple[int, Cell]] = []
        self.codes: list[str] = []

    def add(self, code: str) -> None:
        self.codes.append(code)
        if len(self.codes) == MEMO_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.codes:
            self.add_span(len(self.codes), _short_span(tuple(self.codes)))
            self.codes = []

    def add_span(self, n: int, cell: Cell) -> None:
        while self.open and self.open[-1][0] <= n:
            m, left = self.open.pop()
            n, cell = n + m, joined(left, cell)
        self.open.append((n, cell))

    def cell(self) -> tuple[int, Cell]:
        """(rows, cell of all of them); the cell of no rows is that of insertions."""
        self._flush()
        if not self.open:
            return 0, EMPTY
        n, cell = self.open[-1]
        for m, left in reversed(self.open[:-1]):
            n, cell = n + m, joined(left, cell)
        return n, cell


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of the start symbol."""
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def _order(turn: Column) -> list[Column]:
    return [turn.isNotNull().cast("int").alias("has_turn"), turn.alias("turn")]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): the fixed damage by crc32 of ``conv_id:turn``
    modulo 20, nulls written as one space. A dropped row stays as a mark of its conversation."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy")).drop("copy")


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: ``b`` blank, ``d`` role and text seen at an earlier turn, ``t``
    truncated, ``o`` none, ``-`` dropped; equal rows of one turn are told apart in order later.

    The earlier turn comes from one aggregate with map-side combine over digests; only what
    occurs more than once is joined back, by a broadcast of checked size or a shuffle."""
    trimmed = F.rtrim("text", F.lit(_WHITE))
    d = rows.withColumn("digest", F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
    first = (d.where(~F.col("dropped")).groupBy("conv_id", "digest")
             .agg(F.min(F.struct(*_order(F.col("turn")))).alias("first"), F.max(F.struct(*_order(F.col("turn")))).alias("last"))
             .where("first <> last").select(F.col("conv_id").alias("c"), F.col("digest").alias("g"), "first"))
    d = d.join(small(cut(first, "first-turns"), 128), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")), "left")
    later = F.coalesce(F.struct(*_order(F.col("turn"))) > F.col("first"), F.lit(False))
    fault = (F.when(F.col("dropped"), "-").when(trimmed == "", "b").when(later, "d").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "t").otherwise("o"))
    return d.select("conv_id", *_order(F.col("turn")), "role", "text", fault.alias("fault"))


_SPAN = "conv_id long, part long, rows long, cell string"



def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names))


class _Faults:
    """The last class of a row, known in order: an equal row right before makes it a duplicate."""

    def __init__(self):
        self.before: tuple | None = None

    def __call__(self, row: tuple, fault: str) -> str:
        again, self.before = self.before == row, row
        return "d" if again and fault not in "b-" else fault


def _code(role: str, fault: str) -> str:
    initial = role[:1]
    return (initial if initial and initial in "sua" else " ") + ("x" if fault in "bd" else fault)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of every conversation's run of rows in one ordered partition."""
    from pyspark import TaskContext

    part, out = TaskContext.get().partitionId(), []
    conv, spans, fault_of = None, None, _Faults()

    def done():
        n, cell = spans.cell()
        out.append((conv, part, n, ";".join(f"{p}{q}{c},{x}" for (p, q), (c, x) in cell.items())))

    for c, turn, role, text, fault in _rows(batches, ["conv_id", "turn", "role", "text", "fault"]):
        if spans is None or c != conv:
            if spans is not None:
                done()
            conv, spans, fault_of = c, Spans(), _Faults()
        if fault != "-":
            spans.add(_code(role, fault_of((turn, role, text), fault)))
        if len(out) >= 4096:
            yield _batch(out, _SPAN)
            out = []
    if spans is not None:
        done()
    if out:
        yield _batch(out, _SPAN)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _read_cell(text: str) -> Cell:
    out: Cell = {}
    for item in text.split(";"):
        cost, audit = item[2:].split(",")
        out[int(item[0]), int(item[1])] = (int(cost), audit)
    return out


REPAIRED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired_sha256 string")


class _Repair:
    """One conversation: spans first, then its rows in order; nothing but the audit is held."""

    def __init__(self, conv):
        self.conv, self.spans, self.audit, self.at = conv, Spans(), None, 0
        self.sha, self.written, self.state = hashlib.sha256(), False, 0
        self.seen = dict.fromkeys(("b", "d", "t", "o"), 0)
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.illegal, self.initial, self.fault_of = 0, None, _Faults()

    def plan(self) -> None:
        if self.audit is None:
            n, cell = self.spans.cell()
            self.cost, self.audit = cheapest(cell) if n else (0, "")

    def _write(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.written else "").encode() + role.encode() + b":" + text.encode())
        self.written = True

    def _needed(self) -> str:
        """The user or assistant row that fits here."""
        i = "a" if self.state == 2 else "u"
        self.state = STEPS[self.state, i]
        return _ROLES[i]

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._write(self._needed(), "")

    def row(self, turn, role: str, text: str, fault: str) -> None:
        self.plan()
        fault = self.fault_of((turn, role, text), fault)
        self.seen[fault] += 1
        if turn is not None:
            if self.turns == 0 or turn != self.turn:
                self.turns, self.turn = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = STEPS[self.state, role[:1]]
            self._write(role, text)
        elif edit == "R":
            self._write(self._needed(), text)

    def result(self) -> tuple:
        self.plan()
        self._insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.seen["b"], self.seen["d"], self.seen["t"], self.illegal, self.cost, self.audit, self.sha.hexdigest())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Repair | None = None
    out: list[tuple] = []
    for c, part, n, cell, turn, role, text, fault in _rows(batches, ["conv_id", "part", "rows", "cell", "turn", "role", "text", "fault"]):
        if now is None or c != now.conv:
            if now is not None:
                out.append(now.result())
            now = _Repair(c)
            if len(out) >= 1024:
                yield _batch(out, REPAIRED)
                out = []
        if cell is not None:
            if n:
                now.spans.add_span(n, _read_cell(cell))
        elif fault != "-":
            now.row(turn, role, text, fault)
    if now is not None:
        out.append(now.result())
    if out:
        yield _batch(out, REPAIRED)


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Repair report of every conversation of ``rows(conv_id, turn, role, text, fault)``, as
    ``classified`` gives them: (conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256).

    Rows are put in order of turn (nulls first), then role and text; equal rows are
    interchangeable. Null ids are one conversation. A conversation without rows after the
    damage has zeros, an empty audit and the hash of nothing; an empty table gives an empty
    result. Other columns are not read.

    Ranges of the order are parsed in separate tasks, so one long conversation is cut where
    the ranges end; its cells meet in the second step, ahead of its rows, which pass by one
    at a time for the digest (a hash of one text has one reader). A task holds the audits of
    one conversation, one byte an edit, and no texts.
    """
    prepare_session(spark)
    order = ["conv_id", "has_turn", "turn", "role", "text"]
    cells = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_parse, _SPAN)
    none = lambda k: F.lit(None).cast(k)
    both = cells.select("conv_id", F.lit(0).alias("kind"), "part", "rows", "cell", none("int").alias("has_turn"), none("long").alias("turn"),
                        none("string").alias("role"), none("string").alias("text"), none("string").alias("fault"))
    both = both.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), none("long").alias("part"), none("long").alias("rows"),
                                        none("string").alias("cell"), "has_turn", "turn", "role", "text", "fault"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", *order[1:]).mapInArrow(_repair, REPAIRED)


def q_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged by the fixed rule and repaired."""
    return repair(spark, classified(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def _sql() -> str:
    """The same report by a row-by-row search over the reader's states."""
    crc = ("list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
           "lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)))")
    cell = lambda s, cost, edit: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}}"
    never = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"
    keep = lambda s, initial: f"CASE WHEN fault IN ('o', 't') AND initial = '{initial}' THEN {cell(s, 'more', 'K')} ELSE {never} END"
    turn = lambda s: f"CASE WHEN fault IN ('o', 't') THEN {cell(s, f'{REROLE} + more', 'R')} ELSE {never} END"
    low = lambda *x: f"list_min([{', '.join(x)}])"
    gone = lambda s: cell(s, DELETE, "D")
    extra = lambda s: cell(s, INSERT, "I")
    return rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, xor({crc.format('k')}, CAST(4294967295 AS BIGINT)) % 20 AS kind FROM keyed),
hit AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hit),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'o' END AS fault, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
search(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': ''}}, {never}, {{'c': CAST({INSERT} AS BIGINT), 'a': 'I'}}, {{'c': CAST({2 * INSERT} AS BIGINT), 'a': 'II'}} FROM counts
  UNION ALL
  SELECT conv_id, i, t0, t1, u2, {low('t3', extra('u2'))} FROM (
    SELECT conv_id, i, t0, t1, t3, {low('t2', extra('t0'), extra('t1'), extra('t3'))} AS u2 FROM (
      SELECT conv_id, i, {gone('s0')} AS t0, {low(gone('s1'), keep('s0', 's'))} AS t1,
        {low(gone('s2'), *[keep(s, 'u') for s in ('s0', 's1', 's3')], *[turn(s) for s in ('s0', 's1', 's3')])} AS t2, {low(gone('s3'), keep('s2', 'a'), turn('s2'))} AS t3
      FROM (SELECT s.conv_id, j.i, j.fault, j.initial, CASE WHEN j.fault = 't' THEN {TRUNCATED} ELSE 0 END AS more, s.s0, s.s1, s.s2, s.s3
            FROM search s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i + 1)))),
best AS (SELECT c.conv_id, {low('s0', 's3')} AS b FROM counts c JOIN search s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n),
letters AS (SELECT conv_id, generate_subscripts(string_split(b.a, ''), 1) AS pos, unnest(string_split(b.a, '')) AS edit FROM best WHERE b.a <> ''),
marked AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS outs
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
lines AS (SELECT m.conv_id, m.pos, CASE WHEN m.edit = 'K' THEN j.role WHEN (m.o + m.outs) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN m.edit = 'I' THEN '' ELSE j.text END AS line
  FROM marked m LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.i = m.i AND m.edit <> 'I' WHERE m.edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(b.b.c, 0) AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(x.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL_CONVERSATION_REPAIR = _sql()
