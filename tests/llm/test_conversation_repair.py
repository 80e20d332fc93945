"""Operator 11 against brute force: all edit sequences of small conversations, and a plain
left-to-right search over whole tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from mixshard.llm import conversation_repair as C

WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        found = WORD.findall(text)
        out.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "o")
        seen.add((role, text))
    return out


def search(rows, fault):
    """Cheapest (cost, audit) by a search over (rows done, initials so far), and its rows."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, text = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(text)
        if (i, last) in done:
            continue
        done.add((i, last))
        put = lambda c, e, n, l, t: heapq.heappush(heap, (cost + c, audit + e, n, l, text + t))
        for x in step[last]:
            if x != "s":
                put(3, "I", i, x, (("user" if x == "u" else "assistant") + ":",))
        if i < len(rows):
            _, _, role, t = rows[i]
            put(4, "D", i + 1, last, ())
            if fault[i] not in "bd":
                more = 3 if fault[i] == "t" else 0
                if role[:1] and role[:1] in step[last]:
                    put(more, "K", i + 1, role[:1], (f"{role}:{t}",))
                for x in step[last]:
                    if x != "s":
                        put(3 + more, "R", i + 1, x, (("user" if x == "u" else "assistant") + ":" + t,))
    raise AssertionError


def report(conv, rows):
    rows = sorted((r for r in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    fault = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, text = search(rows, fault) if rows else (0, "", "")
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in "bdt"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def brute(rows):
    by = {c: [] for c in {r[0] for r in rows}}
    for r in damage(rows):
        by[r[0]].append(r)
    return sorted((report(c, v) for c, v in by.items()), key=str)


def test_cells_against_all_edit_sequences():
    """Every choice of edits and of up to two insertions a gap, by the regular expression."""
    gaps = ["", "u", "a", "ua", "au"]
    classes = [(r, f) for r in ("s", "u", "a", "t") for f in "otx"]
    cases = [()] + [(c,) for c in classes] + random.Random(3).sample(list(itertools.product(classes, repeat=2)), 60) + [tuple(random.Random(i).choices(classes, k=3)) for i in range(6)]
    for codes in cases:
        best = None
        for edits in itertools.product(*[[("D", 4, "")] + ([] if f == "x" else [("K", 3 * (f == "t"), r), ("R", 3 + 3 * (f == "t"), "u"), ("R", 3 + 3 * (f == "t"), "a")]) for r, f in codes]):
            for ins in itertools.product(gaps, repeat=len(codes) + 1):
                got = ins[0] + "".join(e[2] + g for e, g in zip(edits, ins[1:]))
                if LEGAL.fullmatch(got):
                    cost = sum(e[1] for e in edits) + 3 * sum(map(len, ins))
                    audit = "I" * len(ins[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, ins[1:]))
                    best = min(best, (cost, audit)) if best else (cost, audit)
        s = C.Spans()
        for r, f in codes:
            s.add((r if r in "sua" else " ") + f)
        n, cell = s.cell()
        assert C.cheapest(cell) == best, codes
        assert n == len(codes)


def test_spans_cut_anywhere_agree():
    r = random.Random(5)
    for n in (1, 7, 8, 9, 40, 333):
        codes = ["".join(r.choice(x) for x in ("sua ", "ootx")) for _ in range(n)]
        whole, parts = C.Spans(), C.Spans()
        for c in codes:
            whole.add(c)
        at = 0
        while at < n:
            k, piece = r.randint(1, 50), C.Spans()
            for c in codes[at: at + k]:
                piece.add(c)
            at += k
            m, cell = piece.cell()
            parts.add_span(m, C._read_cell(";".join(f"{p}{q}{c},{x}" for (p, q), (c, x) in cell.items())))
        assert whole.cell() == parts.cell()


def _table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'x' AS fault", "1 AS part", "2 AS rows", "'c' AS cell", "0 AS first", "'k' AS kind") if extra else df


def _run(spark, df):
    return sorted((tuple(r) for r in C.repair(spark, C.classified(C.damaged(df))).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed):
    r = random.Random(seed)
    texts = ["Yes.", "no", "Why? ", "", "  \t", None, "a.b!", "ends\n", "é ü.", " .x", "Yes.", "long " * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "User"]
    rows = [(r.choice([None, *range(25)]), r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for _ in range(300)]
    rows += rows[:20]
    assert _run(spark, _table(spark, rows, extra=True)) == brute(rows)


def test_one_long_conversation_over_many_partitions(spark):
    """A conversation that holds nearly all rows is parsed in several tasks."""
    r = random.Random(9)
    rows = [(7, i // 2, r.choice(["user", "assistant", "system"]), r.choice(["A.", "b", f"{i}!", ""])) for i in range(1500)] + [(8, 0, "user", "x.")]
    df = _table(spark, rows).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marks = C.classified(C.damaged(df))
        cells = marks.repartitionByRange("conv_id", "has_turn", "turn", "role", "text").sortWithinPartitions("conv_id", "has_turn", "turn", "role", "text").mapInArrow(C._parse, C._SPAN)
        assert cells.where("conv_id = 7").count() > 1
        assert _run(spark, df) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows_all_dropped_all_null(spark):
    assert _run(spark, _table(spark, []))== []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert _run(spark, _table(spark, [(gone, 0, "user", "x.")])) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    rows = [(None, None, None, None)] * 3
    assert _run(spark, _table(spark, rows)) == brute(rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in C.q_conversation_repair(spark, "/root/testdata/sf0.01").collect()), key=str) == brute(rows)
