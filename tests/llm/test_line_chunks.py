"""Operator 4 against a plain version, and shifts."""

import hashlib
import random

from mixshard.llm import line_chunks as C


def split(text, divisor=C.DIVISOR):
    out, part, last = [], [], 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        part.append(line)
        if (last * C.FACTOR + h) % divisor == 0 or i == len(lines) - 1:
            out.append(part)
            part = []
        last = h
    return out


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        parts, kept, gone = split(t), [], 0
        for p in parts:
            body = "\n".join(p)
            if len(p) >= 2 and body in seen:
                gone += len(p)
            else:
                kept.append(body)
            seen.add(body)
        out.append((i, "\n".join(kept), sum(map(len, parts)), len(parts), gone))
    return out


def test_matches_brute_force(spark):
    r = random.Random(2)
    line = lambda: " ".join(r.choices(["a", "b", "éc", "dd"], k=r.randint(0, 6)))
    passages = [[f"p{k} line {i}" for i in range(12)] for k in range(4)]
    rows = [(0, None), (1, ""), (2, "\n\n\n\n"), (3, "\n".join(["same"] * 500)), (4, "x" * 200_000), (5, "\n".join(f"l{i}" for i in range(5000)))]
    for i in range(6, 150):
        own = [line() for _ in range(r.randint(1, 12))]
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(own) + 1)
            own[k:k] = r.choice(passages)
        rows.append((i, "\n".join(own)))
    rows += [(200, rows[5][1]), (201, rows[20][1])]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, body string, n_lines int")
    got = C.dedup_lines(spark, df)
    assert got.columns == ["doc_id", "text", "body", "n_lines", "n_chunks", "removed_lines"]
    assert sorted(tuple(x) for x in got.select("doc_id", "text", "n_lines", "n_chunks", "removed_lines").collect()) == sorted(brute(rows))
    assert sum(b[4] for b in brute(rows)) > 500


def test_shifted_passage_is_found(spark):
    passage = "\n".join(f"line {i} of a passage that many documents hold" for i in range(40))
    df = spark.createDataFrame([(i, "\n".join(f"own {i} {k}" for k in range(i)) + "\n" + passage + f"\nend {i}") for i in range(12)], "doc_id long, text string")
    got = {x["doc_id"]: x["removed_lines"] for x in C.dedup_lines(spark, df).collect()}
    assert got[0] == 0 and all(got[i] >= 28 for i in range(1, 12))


def test_whole_runs_go(spark):
    """Passages of 1 to 40 lines between neighbours of their own: all lines of all later copies go."""
    passages = {k: [f"{k} {i} " + " ".join(f"w{j}" for j in range(60 if k == 1 else 3)) for i in range(k)] for k in (1, 2, 3, 4, 6, 8, 12, 40)}
    rows = [(n, "\n".join(x for k, p in passages.items() for x in (f"own {n} {k}", *p)) + f"\nend {n}") for n in range(6)]
    rows += [(6, None), (7, ""), (8, "\n\n\n"), (9, "\n\n\n"), (10, "\n".join(["same"] * 5)), (11, "x\ny\nz"), (12, "y\nz\nq"), (13, "x\ny"), (14, "z\nq")]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["removed_lines"]) for r in C.dedup_runs(spark, df).collect()}
    lines = sum(passages)
    assert got[0] == (rows[0][1], lines + len(passages) + 1, 0)
    for n in range(1, 6):
        assert got[n] == ("\n".join([f"own {n} {k}" for k in passages] + [f"end {n}"]), lines + len(passages) + 1, lines)
    assert [got[n] for n in range(6, 11)] == [(None, 0, 0), ("", 1, 0), ("\n\n\n", 4, 0), ("\n\n\n", 4, 0), ("same\nsame", 5, 3)]
    # z q stands in 12 first and in 14 again: it stays whole in 12
    assert [got[n][0] for n in range(11, 15)] == ["x\ny\nz", "z\nq", "", ""]
    missed = sum(lines - r["removed_lines"] for r in C.dedup_lines(spark, spark.createDataFrame(rows[:6], df.schema)).collect() if r["doc_id"])
    assert missed > 0  # the chunk rule leaves some of them


def test_repeats_null_ids_no_rows(spark):
    t = "\n".join(f"line {i}" for i in range(20))
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    got = {(x["doc_id"], x["removed_lines"] > 0) for x in C.dedup_lines(spark, df).collect()}
    assert got == {(1, False), (None, True)}
    assert C.dedup_lines(spark, df.where("false")).count() == 0


def test_plan_is_native(spark):
    plan = C.q_line_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
