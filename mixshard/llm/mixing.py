"""Mixing sources to target weights by iterative proportional fitting (operator 9).

DataFrame functions only. Documents are counted into cells (source, language, topic) with
map-side partial sums; raking then works on cells alone: each step scales the cells of
every value of one dimension to that value's target. Rows of a cell share one sampling
probability, the cell's raked weight over its tokens, scaled so that the largest is 1. A
document is kept when a hash of its id, as a number in [0, 1), lies below it. That scale
makes the sample as small as the scarcest cell asks. With a share of the tokens as the
budget (the query and the pipeline) cells that ask for more than they have are taken whole
and the others share what is left; with a number of tokens as the budget a rate above 1
gives whole repeats and a hashed rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixshard.llm.columns import BROADCAST_BYTES
from mixshard.session import cut, prepare_session

DIMENSIONS = ("source", "lang", "topic")
#: Where no targets are given, a value's target share grows with this power of its tokens.
POWER = 0.7
ROUNDS, SEED = 6, "mix"
#: Share of all tokens that the registered sample and the pipeline's hold.
SHARE = 0.8
_SYMBOLS = "#*$%&|<>"


def n_words(text: Column) -> Column:
    """Tokens of a document: its white-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, words: Column) -> Column:
    """A stand-in for a topic label, which the tables lack: the make-up of the text."""
    symbols = F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))
    return (F.when(words == 0, "none").when(symbols * 5 >= words, "symbols").when(words < 100, "short").when(words < 1000, "medium").otherwise("long"))


def draw(id_: Column) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of the id and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), id_.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rake(cells: DataFrame, targets: dict[str, dict] | None = None, power: float = POWER, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """``cells`` (the dimensions, tokens) with their raked ``weight``; weights add up to 1.

    With a ``tolerance`` raking ends when no margin was further than that from its target,
    relative to it, and raises after ``rounds`` rounds: margins that contradict each other
    (a value that occurs in one cell only, wanted at two shares) have no solution.

    ``targets`` maps a dimension to the shares of its values (scaled to the values present;
    values without a share get none). Other dimensions aim at tokens ** power. Cells without
    tokens have no weight. Every step is written: it holds one row a cell.
    """
    filled = cells.where("tokens > 0")
    total = filled.agg(F.sum("tokens")).first()[0] or 1
    now = filled.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    aims = {}
    for d in DIMENSIONS:
        if targets and d in targets:
            share = F.coalesce(*[F.when(F.col(d) == F.lit(k), F.lit(float(v))) for k, v in targets[d].items()], F.lit(0.0))
        else:
            share = F.pow(F.sum("tokens").cast("double"), F.lit(power))
        if targets and d in targets:
            aim = filled.select(d).distinct().withColumn("share", share)
        else:
            aim = filled.groupBy(d).agg(share.alias("share"))
        aim = cut(aim, "aims")
        whole = aim.agg(F.sum("share")).first()[0] or 1.0
        aims[d] = aim.select(F.col(d).alias("__v"), (F.col("share") / F.lit(float(whole))).alias("aim"))
    for _ in range(rounds):
        worst = 0.0
        for d in DIMENSIONS:
            held = now.groupBy(F.col(d).alias("__v")).agg(F.sum("weight").alias("held"))
            met = held.join(aims[d], held["__v"].eqNullSafe(aims[d]["__v"]))
            if tolerance is not None:
                off = met.agg(F.max(F.when(F.col("aim") > 0, F.abs(F.col("held") - F.col("aim")) / F.col("aim")).otherwise(F.col("held")))).first()[0]
                worst = max(worst, off or 0.0)
            factor = met.select(held["__v"], F.when(F.col("held") > 0, F.col("aim") / F.col("held")).otherwise(0.0).alias("factor"))
            now = cut(now.join(factor, now[d].eqNullSafe(factor["__v"])).select(*DIMENSIONS, "tokens", (F.col("weight") * F.col("factor")).alias("weight")), "raked", after=now if hasattr(now, "_cut_path") else None)
        if tolerance is not None and worst <= tolerance:
            return now
    if tolerance is not None:
        raise ValueError(f"margins still {worst:.3g} off their targets after {rounds} rounds")
    return now


def filled(raked: DataFrame, budget: float) -> float:
    """The factor f for which the sum over cells of min(tokens, f weight) is ``budget`` tokens.

    Cells in falling order of weight over tokens: those ahead of the first that keeps below its
    tokens are taken whole. Infinite where all are. One row a cell, in one ordered pass."""
    rate = (F.col("weight") / F.col("tokens")).alias("rate")
    order = Window.orderBy(F.col("rate").desc(), *[F.col(d).asc_nulls_first() for d in DIMENSIONS])
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    steps = raked.where("weight > 0").select("*", rate).withColumn("f", (F.lit(float(budget)) - before) / rest)
    found = steps.where(F.col("f") * F.col("rate") < 1).agg(F.max_by("f", "rate")).first()[0]
    return float("inf") if found is None else float(found)


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        targets: dict[str, dict] | None = None, power: float = POWER, rounds: int = ROUNDS, tolerance: float | None = None, tokens: float | None = None, share: float | None = None) -> DataFrame:
    """(row, source, lang, topic, n_tokens, probability, kept): ``row`` is a struct of all
    columns of ``docs``; one row per input row.

    ``share``: share of all tokens in the sample, as an expected value, no row more than once:
    cells whose targets ask for more than they hold are taken whole (see ``filled``), so
    margins are met as far as distinct documents allow, and a scarce cell does not thin the others.

    ``tokens``: tokens of the sample, as an expected value. It adds ``rate``, the copies of a
    row that are expected, and ``copies``: the whole part of the rate, and one more when the
    draw lies below the rest. ``probability`` is then that of at least one copy.
    ``tolerance``: see ``rake``.

    Defined cases: a null source or language is a value of its own; null, empty and blank texts
    have no tokens, probability 0 and are not kept; rows with a null id share one draw;
    repeated rows share a fate; an empty table gives an empty result.
    """
    prepare_session(spark)
    words = n_words(F.col(text_col))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).alias("__t"), words.alias("n_tokens"), F.col(id_col).alias("__id"))
    rows = rows.withColumn("topic", F.coalesce(topic(F.col("__t"), F.col("n_tokens")), F.lit("none")))
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = rake(cells, targets, power, rounds, tolerance)
    rate = raked.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], (F.col("weight") / F.col("tokens")).alias("rate"))
    n, top, total = raked.agg(F.count("*"), F.max(F.col("weight") / F.col("tokens")), F.sum("tokens")).first()
    if share is not None:
        if tokens is not None or not 0 < share <= 1:
            raise ValueError("give a share within (0, 1] or a number of tokens")
        scaled = F.when(F.col("rate") > 0, F.least(F.lit(1.0), F.col("rate") * F.lit(filled(raked, share * float(total or 0))))).otherwise(0.0)
    else:
        scaled = F.col("rate") / F.lit(float(top or 1.0)) if tokens is None else F.col("rate") * F.lit(float(tokens))
    rate = rate.withColumn("rate", scaled)
    if n * 128 <= BROADCAST_BYTES:
        rate = F.broadcast(rate)
    same = [rows[d].eqNullSafe(rate[f"__{d}"]) for d in DIMENSIONS]
    p = F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    u = draw(F.coalesce(F.col("__id").cast("string"), F.lit("")))
    out = rows.join(rate, same[0] & same[1] & same[2], "left")
    if tokens is None:
        return out.withColumn("probability", p).select("row", *DIMENSIONS, "n_tokens", "probability", (u < F.col("probability")).alias("kept"))
    out = out.withColumn("rate", p).withColumn("copies", F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long"))
    return out.select("row", *DIMENSIONS, "n_tokens", F.least("rate", F.lit(1.0)).alias("probability"), (F.col("copies") > 0).alias("kept"), "rate", "copies")


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability and decision of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(spark, docs, share=SHARE).select("row.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def _sql() -> str:
    steps, before = [], "w0"
    for r in range(ROUNDS):
        for d in DIMENSIONS:
            name = f"w{r}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * (pow(sum(tokens) OVER (PARTITION BY {d}), {POWER}) / a.whole_{d}) / sum(weight) OVER (PARTITION BY {d}) AS weight FROM {before}, aims a)")
            before = name
    aims = ", ".join(f"(SELECT sum(s) FROM (SELECT pow(sum(tokens), {POWER}) AS s FROM cells GROUP BY {d})) AS whole_{d}" for d in DIMENSIONS)
    return rf"""
WITH n AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'none' WHEN (length(t) - length(translate(t, '{_SYMBOLS}', ''))) * 5 >= n_tokens THEN 'symbols'
  WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM n),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
aims AS MATERIALIZED (SELECT {aims}),
w0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM cells) AS weight FROM cells),
{", ".join(steps)},
ordered AS (SELECT *, weight / tokens AS rate, ({SHARE} * (SELECT sum(tokens) FROM cells)
    - coalesce(sum(tokens) OVER (ORDER BY weight / tokens DESC, source NULLS FIRST, lang NULLS FIRST, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY weight / tokens DESC, source NULLS FIRST, lang NULLS FIRST, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM {before}),
factor AS (SELECT arg_max(f, rate) AS f FROM ordered WHERE f * rate < 1)
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.n_tokens AS BIGINT) AS n_tokens, round(coalesce(p.p, 0), 6) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p.p, 0) AS kept
FROM d LEFT JOIN (SELECT source, lang, topic, least(1.0, weight / tokens * coalesce((SELECT f FROM factor), 'inf'::DOUBLE)) AS p FROM {before}) p
  ON p.source IS NOT DISTINCT FROM d.source AND p.lang IS NOT DISTINCT FROM d.lang AND p.topic = d.topic
"""


SQL_MIXING = _sql()
