"""Personal data with candidate generators and boosted trees (operator 7).

DataFrame functions only: every step is an expression over one row, so a scan needs no
shuffle and no Python on the executors. Base rules find e-mail addresses, IP addresses,
payment cards and international phone numbers. High-recall generators then propose more
spans; gradient-boosted trees over format and context features score them; a span is
selected when its score passes the calibrated threshold of its kind, it overlaps no base
span, and no overlapping candidate has a larger margin.

Positions come from one regular-expression pass: the pieces between matches and the
matches themselves alternate, so their lengths add up to the starts. The patterns use
possessive character classes and no repeated groups, so neither long runs nor long texts
make the matcher recurse or backtrack.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm.columns import let
from mixshard.session import prepare_session

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order in which they are listed after the base kinds.
ADDED = ("secret", "number", "account", "hidden_email")
#: Precision that a threshold must reach in cross-validation, trees, shrinkage.
PRECISION, TREES, SHRINK, FOLDS = 0.98, 24, 0.4, 5

# \x01 stands for a joining character (see ``_joined``); \x02 for a \x01 of the text itself
_LOCAL = r"A-Za-z0-9._%+\x01-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]{12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+",
    "number": r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2,6}(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,12}",
}


def _joined(text: Column, sides: str, joins: str) -> Column:
    """``text`` with every joining character that has ``sides`` on both sides written as \\x01
    (one character for one), so that a repeated group becomes a character class."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), f"(?<=[{sides}])[{joins}](?=[{sides}])", "\x01")


def spans(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<start, s, before>> of all matches: code-point start, matched text, and up
    to 24 characters before it; empty unless ``when``."""
    empty = F.array().cast("array<struct<start:long,s:string,before:string>>")
    step = lambda s, x: F.struct((s["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct(
        (s["at"] + F.length(x["p"])).alias("start"), x["m"].alias("s"), F.right(x["p"], F.lit(24)).alias("before")))).alias("out"))
    inner = lambda s, c: F.aggregate(c, F.struct(s["at"].alias("at"), empty.alias("out")), step)
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:long,s:string,before:string>>>").alias("out"))

    def starts(pairs: Column) -> Column:
        # running sums in chunks, so that a text with n matches copies far fewer than n^2 elements
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / 256).cast("int")), lambda c: F.slice(pairs, c * 256 + 1, 256))
        return F.flatten(F.aggregate(chunks, first, lambda s, c: let(inner(s, c), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out"))))["out"])

    def located(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("p"), found.alias("m"))
        return F.when(F.size(found) > 0, let(pairs, starts)).otherwise(empty)

    return F.when(when, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(empty)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  i-th from the right
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the four base kinds, after their checks."""
    number = F.contains(text, F.lit(".")) | F.rlike(text, F.lit("[0-9]"))
    long_digits = lambda s: F.length(_digits(s))
    short = lambda p: F.ltrim(p, F.lit("0"))
    ip_ok = lambda x: F.forall(F.split(x["s"], r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(F.when(F.length(short(p)) <= 3, short(p).try_cast("int")), F.lit(0)) <= 255))
    card_ok = lambda x: long_digits(x["s"]).between(13, 19) & luhn(_digits(x["s"]))
    return {
        "email": spans(_joined(text, "A-Za-z0-9-", "."), EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP, number), ip_ok),
        "card": F.filter(spans(_joined(text, "0-9", r"\x20-"), CARD, number), card_ok),
        "phone": F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: long_digits(x["s"]).between(9, 15)),
    }


# --- the added spans

FEATURES = ("length", "digits", "upper", "lower", "hex", "separators", "distinct", "runs", "key_before", "phone_before", "id_before", "social", "phone_like", "date_like", "quoted")


def features(x: Column) -> dict[str, Column]:
    """Format and context features of a candidate struct (s, before)."""
    s, before = x["s"], x["before"]
    n = F.length(s).cast("double")
    share = lambda cls: F.length(F.regexp_replace(s, f"[^{cls}]", "")) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": n, "digits": share("0-9"), "upper": share("A-Z"), "lower": share("a-z"), "hex": share("0-9a-fA-F"), "separators": share(r"\x20./_()+-"),
        "distinct": F.size(F.array_distinct(F.split(s, ""))) / n, "runs": F.length(F.regexp_replace(s, "[0-9]+|[^0-9]+", "x")).cast("double"),
        "key_before": flag(F.rlike(before, F.lit(r"(?i)(pass(word|wd)?|pwd|token|secret|key|auth|bearer)[\x20\"':=]*$"))),
        "phone_before": flag(F.rlike(before, F.lit(r"(?i)(tel|phone|call|fax|mobile|cell)[^A-Za-z]*$"))),
        "id_before": flag(F.rlike(before, F.lit(r"(?i)(ssn|social security|passport|iban|account|konto)[^A-Za-z]*$"))),
        "social": flag(F.rlike(s, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))),
        "phone_like": flag(F.rlike(s, F.lit(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"))),
        "date_like": flag(F.rlike(s, F.lit(r"^((19|20)[0-9]{2}[.-][0-9]{2}[.-][0-9]{2}|[0-9]{2}[.-][0-9]{2}[.-](19|20)?[0-9]{2})$"))),
        "quoted": flag(F.rlike(before, F.lit("[\"']$"))),
    }


def labelled_candidates() -> list[tuple[str, str, str, int]]:
    """The small labelled table (kind, before, candidate, 1 for private): formats of keys,
    numbers and accounts, and of the dates, codes and names that look like them."""
    r = random.Random(4)
    pick = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = []
    plain = ["in the text ", "see ", "was then ", "", "part ", "of the item "]
    for i in range(30):
        b = r.choice(plain)
        out += [("secret", b + r.choice(["password=", "token = \"", "secret: ", "api_key=", "Bearer "]), pick("0123456789abcdef", r.choice([16, 18, 32, 40])), 1),
                ("secret", b, "AKIA" + pick(up + digits, 16), 1), ("secret", b + r.choice(["key: ", "pwd="]), pick(low + up + digits, r.randint(12, 44)) + "7", 1),
                ("secret", b, "sk-" + pick(low + up + digits, 40) + "1", 1),
                ("secret", b, pick(low, r.randint(5, 8)) + "-" + pick(low, 6) + str(r.randint(1, 30)), 0), ("secret", b, pick(low, r.randint(12, 20)) + str(r.randint(1, 9)), 0),
                ("secret", b, pick(digits, r.randint(12, 30)), 0), ("secret", b, pick(low, 4) + "/" + pick(low, 7) + "/" + str(r.randint(100, 2100)), 0),
                ("secret", b, f"{r.randint(1990, 2030)}-{pick(low, 5)}-{pick(low, 6)}", 0), ("secret", b, pick(up, 3) + "-" + pick(digits, 4) + "-" + pick(up, 4), 0),
                ("number", b, f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", 1), ("number", b + r.choice(["tel. ", "call: ", "phone "]), f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", 1),
                ("number", b, f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", 1), ("number", b + r.choice(["", "SSN "]), f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", 1),
                ("number", b + "Tel: ", f"0{pick(digits, 3)} {pick(digits, 3)} {pick(digits, 4)}", 1),
                ("number", b, f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", 0), ("number", b, f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1950, 2030)}", 0),
                ("number", b, f"{pick(digits, 2)}.{pick(digits, 2)}.{pick(digits, 3)}", 0), ("number", b, f"{pick(digits, 2)} {pick(digits, 3)} {pick(digits, 3)}", 0),
                ("number", b, f"{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}", 0), ("number", b, f"{r.randint(1900, 2030)} {r.randint(1900, 2030)} {r.randint(1900, 2030)}", 0),
                ("account", b + r.choice(["IBAN ", "", "Konto: "]), r.choice(["DE", "FR", "ES", "GB"]) + pick(digits, r.choice([16, 18, 20])), 1),
                ("account", b, "DE" + pick(digits, 2) + "".join(" " + pick(digits, 4) for _ in range(4)) + " " + pick(digits, 2), 1),
                ("account", b, pick(up, 2) + pick(digits, 2) + pick(up, 12), 0), ("account", b, pick(up, 2) + pick(digits, 2) + " " + pick(up, 4) + " " + pick(up, 4) + " " + pick(up, 4), 0),
                ("hidden_email", b, f"{pick(low, 5)} (at) {pick(low, 5)} (dot) com", 1), ("hidden_email", b, f"{pick(low, 5)}.{pick(digits, 2)}[at]{pick(low, 5)}[dot]org", 1),
                ("hidden_email", b, f"{pick(up, 1)} (at) {pick(digits, 2)} (dot) {pick(up, 9)}", 0)]
    # long keys and keys without a digit, and the words, paths and rules that look like them
    r, word = random.Random(5), lambda: pick(low, r.randint(3, 9))
    pick = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    for i in range(30):
        b = r.choice(plain)
        k = b + r.choice(["password=", "token = \"", "secret: ", "api_key=", "Bearer ", "pwd="])
        out += [("secret", r.choice([b, k]), pick(low + up + digits + "-_", 342), 1), ("secret", r.choice([b, k]), pick(low + up + digits + "+/", r.randint(257, 1600)), 1),
                ("secret", k, pick("0123456789abcdef", r.choice([256, 512])), 1), ("secret", k, pick(low + up, r.randint(16, 44)), 1), ("secret", b, pick(low + up, r.randint(28, 64)), 1),
                ("secret", b, pick(low, r.randint(12, 24)), 0), ("secret", b, pick(up, 1) + pick(low, r.randint(11, 20)), 0), ("secret", b, pick(up, r.randint(12, 24)), 0),
                ("secret", b, "-".join(word() for _ in range(r.randint(3, 40))), 0), ("secret", b, "/" + "/".join(word() for _ in range(r.randint(3, 60))), 0),
                ("secret", b, "".join(word().title() for _ in range(r.randint(2, 5))), 0), ("secret", b, "_".join(word().upper() for _ in range(r.randint(2, 6))), 0),
                ("secret", b, "/".join(word() + r.choice(["", str(r.randint(1, 99))]) for _ in range(r.randint(30, 80))), 0),
                ("secret", b, r.choice("-_/+xA0") * r.randint(12, 3000), 0), ("secret", b, word() * r.randint(12, 200), 0), ("secret", b, pick(digits, r.randint(257, 900)), 0)]
    return out


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """(start, trees): gradient boosting on the logistic loss; a tree of depth two is
    (feature, threshold, low, high), a leaf a number."""
    share = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    f, trees = np.full(len(y), start), []
    for _ in range(TREES if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-f))
        tree = _grow(x, y - p, p * (1 - p), 2)
        f = f + np.array([_apply(tree, row) for row in x])
        trees.append(tree)
    return start, trees


def _grow(x, g, h, depth):
    leaf = round(SHRINK * float(g.sum() / (h.sum() + 1.0)), 6)
    if depth == 0 or len(g) < 4:
        return leaf
    best = (1e-6, None)
    for k in range(x.shape[1]):
        for t in np.unique(x[:, k])[:-1]:
            low = x[:, k] <= t
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0] + 1e-9:
                above = x[~low, k].min()
                best = (gain, (k, round(float((t + above) / 2), 6), low))
    if best[1] is None:
        return leaf
    k, t, low = best[1]
    return (k, t, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _apply(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def margin(model: tuple[float, list], row) -> float:
    return model[0] + sum(_apply(t, row) for t in model[1])


def calibrate(x: np.ndarray, y: np.ndarray) -> float:
    """Lowest score at which cross-validated precision reaches PRECISION (never below 0)."""
    fold = np.random.default_rng(0).permutation(len(y)) % FOLDS
    score = np.zeros(len(y))
    for k in range(FOLDS):
        model = boost(x[fold != k], y[fold != k])
        score[fold == k] = [margin(model, row) for row in x[fold == k]]
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    return round(max(0.0, float(score[order][good[-1]])), 6) if len(good) else float("inf")


_MODELS: dict = {}


def models(spark: SparkSession) -> dict[str, tuple[tuple[float, list], float]]:
    """(model, threshold) of each added kind; features of the labelled table are computed by
    the same expressions that score the texts, then the trees are fitted on the driver."""
    if not _MODELS:
        rows = spark.createDataFrame([(i, *r) for i, r in enumerate(labelled_candidates())], "i int, kind string, before string, s string, y int")
        f = features(F.struct("s", "before"))
        got = rows.select("i", "kind", "y", *[f[k].alias(k) for k in FEATURES]).orderBy("i").collect()
        for kind in ADDED:
            own = [r for r in got if r["kind"] == kind]
            x, y = np.array([[float(r[k]) for k in FEATURES] for r in own]), np.array([r["y"] for r in own], float)
            _MODELS[kind] = (boost(x, y), calibrate(x, y))
    return _MODELS


def _score(model: tuple[float, list], x: Column) -> Column:
    f = features(x)

    def column(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[FEATURES[tree[0]]] <= F.lit(float(tree[1])), column(tree[2])).otherwise(column(tree[3]))

    return sum((column(t) for t in model[1]), F.lit(model[0]))


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, added): one row per input row. ``base`` and ``added`` are arrays of
    (kind, start, end, s), code points, end exclusive, ordered by kind as listed, then start.

    Null and empty texts have no spans; null ids stay null; repeated rows are repeated;
    other columns are not read; an empty table gives an empty result.
    """
    prepare_session(spark)
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = lambda kind, a: F.transform(a, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["s"])).alias("end"),
                                                            F.substring(F.col("text"), (x["start"] + 1).cast("int"), F.length(x["s"])).alias("s")))
    base = base_spans(text)
    rows = rows.select("id", "text", *[c.alias(f"b_{k}") for k, c in base.items()],
                       *[spans(text, GENERATORS[k], F.lit(True) if k == "secret" else F.rlike(text, F.lit(r"[\[(](?:at|AT)[\])]")) if k == "hidden_email" else F.rlike(text, F.lit("[0-9]"))).alias(f"g_{k}") for k in ADDED])
    fitted = models(spark)

    def selected(kind: str) -> Column:
        model, least = fitted[kind]
        with_score = F.transform(f"g_{kind}", lambda x: F.struct(x["start"].alias("start"), x["s"].alias("s"), _score(model, x).alias("score")))
        return F.transform(F.filter(with_score, lambda x: x["score"] >= least), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["s"])).alias("end"), x["s"].alias("s"), (x["score"] - least).alias("margin")))

    scored = [selected(k) for k in ADDED]
    rows = rows.select("id", "text", F.concat(*[own(k, F.col(f"b_{k}")) for k in BASE]).alias("base"), F.concat(*scored).alias("new"))
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter("new", lambda x: ~F.exists("base", lambda b: meet(x, b)))
    rows = rows.select("id", "text", "base", F.when(F.size("new") > 0, free).otherwise(F.col("new")).alias("new"))
    best = F.filter("new", lambda x: ~F.exists("new", lambda y: meet(x, y) & ((y["margin"] > x["margin"]) | (y["margin"] == x["margin"]) & (y["start"] < x["start"]))))
    return rows.select("id", "text", "base", F.transform(F.when(F.size("new") > 1, best).otherwise(F.col("new")), lambda x: x.dropFields("margin")).alias("added"))


def redact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): texts with every found span replaced by its kind in angle brackets.

    Overlapping base spans are merged under the kind that starts first."""
    every = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(b["end"] - a["end"])).cast("int"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    put = lambda s, x: F.when(x["start"] < s["at"], F.struct(s["done"].alias("done"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(F.struct(
        F.concat(s["done"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")).alias("done"), x["end"].alias("at")))
    out = F.aggregate(every, start, put, lambda s: F.concat(s["done"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    return find(spark, docs, id_col, text_col).select("id", F.when(F.size("base") + F.size("added") > 0, out).otherwise(F.col("text")).alias("text"))


def q_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    found = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    listed = lambda a: F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(F.concat_ws(",", listed(F.col("base"))), 256).alias("base_sha256"),
                        F.concat_ws(",", F.concat(listed(F.col("base")), listed(F.col("added")))).alias("spans"))
