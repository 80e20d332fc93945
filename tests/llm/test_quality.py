"""Operator 10 against a brute-force version."""

import random
import re

import zstandard

from mixshard.llm import quality as Q


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    raw, z, kept = t.encode(), zstandard.ZstdCompressor(level=3), not failed
    if raw:
        low, high = [b[1:] for b in Q.WHOLE_BANDS if b[0] <= len(raw)][-1]
        kept &= low <= len(z.compress(raw)) / len(raw) <= high
        parts = [raw[i:i + 2048] for i in range(0, len(raw) - 2047, 2048)]
        kept &= 2 * sum(not 0.2 <= len(z.compress(p)) / 2048 <= 0.78 for p in parts) <= len(parts)
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), failed, bool(kept) and bool(raw))


def test_matches_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghé日#*", k=r.randint(1, 9)))
    texts = [None, "", " \n\t", "a", "line\nline\n \nline", "x" * 5000, "".join(chr(r.randrange(33, 127)) for _ in range(9000)), "ab\r\nab\r\n\n", "same words " * 900]
    for _ in range(60):
        ws = [word() for _ in range(r.choice([5, 19, 20, 60, 400]))]
        if r.random() < 0.5:
            k = r.randrange(len(ws))
            ws = ws + ws[k:k + r.choice([7, 8, 30])] * r.randint(1, 3)
        texts.append("".join(w + r.choice([" ", " ", "\n", "\t", "  "]) for w in ws))
    df = spark.createDataFrame([(i, t, 1.5, "x") for i, t in enumerate(texts)], "doc_id long, text string, ratio double, kept string")
    got = {x["id"]: (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"]) for x in Q.quality(spark, df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), repr(t)[:80]


def test_keeps_prose_rejects_the_rest(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(4000)]
    prose = [" ".join(r.choices(vocabulary, k=n)) + "." for n in (30, 100, 500, 5000)]
    import base64
    noise = [" ".join(base64.b64encode(r.randbytes(18)).decode() for _ in range(n)) for n in (100, 600)]
    got = {x["id"]: x["kept"] for x in Q.quality(spark, spark.createDataFrame(list(enumerate(prose + noise + ["ab cd " * 400])), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(7)] == [True] * 4 + [False] * 3


def test_incompressible_passages_reject():
    import base64

    r = random.Random(7)
    vocabulary = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))[:n].encode()
    noise = lambda n: base64.b64encode(r.randbytes(n))[:n]
    kept = lambda raw: Q.bands(raw, zstandard.ZstdCompressor(level=3))[3]
    for n in (600, 1000, 1900, 2047, 2048, 3000, 4000, 38000):
        assert all(kept(prose(n)) for _ in range(20)), n
    mixed = [prose(20000) + noise(18000), noise(18000) + prose(20000), prose(2100) + noise(1900), prose(1100) + noise(800), prose(10000) + noise(6000) + prose(20000)]
    assert not any(map(kept, mixed))


def test_no_rows_null_ids_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert Q.quality(spark, df.where("false")).count() == 0
    assert sorted(str(x["id"]) for x in Q.quality(spark, df).collect()) == ["1", "1", "None"]
