"""Line dedup by content-defined chunks (operator 4).

DataFrame functions only. Every line has a hash; a rolling hash over neighbouring line
hashes chooses the chunk borders, so a passage is cut alike wherever it stands. Chunks of
two lines or more that occur again are removed, all but the first by document id and
position, after a comparison of their bytes.

Only keys (two hashes, id, position) are shuffled for the search; texts of repeated
chunks are met in place while the list of repeated keys fits a checked broadcast, and are
shuffled beyond it. A chunk that a third of all rows hold is one key with map-side
partial aggregates.

Chunks miss repeated passages that hold no whole chunk, and the ends of others
(``dedup_lines``, the query). ``dedup_runs`` looks at every pair of neighbouring lines
instead and finds repeated runs whole, with a key for each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm.columns import let, small
from mixshard.session import cut, prepare_session

#: A border follows a line when the rolling hash of it and the line before leaves 0 modulo
#: DIVISOR: chunks have DIVISOR lines on average. Chunks below LEAST lines are never removed.
DIVISOR, FACTOR, LEAST = 3, 31, 2
#: A line of this many words is a run by itself.
LONE_WORDS = 50


def line_hash(line: Column) -> Column:
    """32 bits of a line's MD5 as a long."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """array<struct<pos, lines, body>> of a text; null for a null text."""

    def cut(lines: Column, hashes: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), hashes)
        rolled = F.zip_with(F.slice(before, 1, F.size(hashes)), hashes, lambda a, b: (a * FACTOR + b) % divisor)
        ends = F.filter(F.transform(rolled, lambda r, i: F.when((r == 0) | (i == F.size(lines) - 1), i)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda end, k: let(F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1), lambda start: F.struct(
            k.cast("long").alias("pos"), (end - start + 1).cast("long").alias("lines"), F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("body")))))

    return F.when(text.isNotNull(), let(F.split(text, "\n", -1), lambda lines: let(F.transform(lines, line_hash), lambda h: cut(lines, h))))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text_col``, plus ``n_lines``,
    ``n_chunks`` and ``removed_lines`` (columns of these names are replaced).

    The first occurrence stays: smallest id, nulls last, then position. Defined cases: a null
    text stays null with zero counts; an empty text is one empty line and stays; a text whose
    chunks all go becomes empty; blank lines are lines; rows that repeat an id and a text are
    one document and get the same result; other columns pass through; an empty table gives an
    empty result.
    """
    prepare_session(spark)
    text, id_ = F.col(text_col), F.col(id_col).cast("long")
    rid = F.xxhash64(id_, text)
    keys = cut(docs.select(id_.alias("id"), rid.alias("rid"), F.explode(chunks(text, divisor)).alias("c")).where(F.col("c.lines") >= LEAST)
            .select("id", "rid", "c.pos", "c.lines", F.xxhash64("c.body").alias("k1"), F.xxhash64(F.lit(17), "c.body").alias("k2")), "chunk-keys")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid", "pos")
    again = cut(keys.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("k1", "k2", "first"), "chunks-again")
    # the bytes of every repeated chunk: equal hashes must mean equal bodies
    bodies = (docs.select(id_.alias("id"), rid.alias("rid"), F.explode(chunks(text, divisor)).alias("c")).where(F.col("c.lines") >= LEAST)
              .select("id", "rid", "c.pos", "c.body", F.xxhash64("c.body").alias("k1"), F.xxhash64(F.lit(17), "c.body").alias("k2")).join(small(again.select("k1", "k2")), ["k1", "k2"], "left_semi"))
    alike = cut(bodies.groupBy("k1", "k2").agg((F.min("body") == F.max("body")).alias("alike")), "chunks-alike")
    gone = keys.join(small(again.join(alike.where("alike"), ["k1", "k2"]), 64), ["k1", "k2"]).where(place != F.col("first")).select("rid", "pos", "lines")
    if not alike.where("not alike").isEmpty():  # different bodies under one hash: compare the bodies themselves
        odd = bodies.join(alike.where("not alike"), ["k1", "k2"], "left_semi").withColumn("lines", F.size(F.split("body", "\n", -1)).cast("long"))
        first = odd.groupBy("k1", "k2", "body").agg(F.min(place).alias("first"))
        gone = gone.unionByName(odd.join(first, ["k1", "k2", "body"]).where(place != F.col("first")).select("rid", "pos", "lines"))
    gone = cut(gone.groupBy("rid").agg(F.collect_set("pos").alias("gone"), F.sum("lines").alias("removed")).withColumnRenamed("rid", "__rid"), "chunks-gone")
    kept = lambda c: F.array_join(F.transform(F.filter(c, lambda x: ~F.array_contains(F.col("gone"), x["pos"])), lambda x: x["body"]), "\n")
    rest = [c for c in docs.columns if c not in ("n_lines", "n_chunks", "removed_lines")]
    own = F.struct(*[F.col(c) for c in rest]).alias("__row")
    joined = docs.select(own, rid.alias("__rid")).join(small(gone, 128), "__rid", "left")
    t = F.col("__row").getField(text_col)
    counted = lambda a: let(a, lambda c: F.struct(F.size(c).cast("long").alias("n"), F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["lines"]).alias("lines"),
                                                  F.when(F.col("gone").isNull(), t).otherwise(kept(c)).alias("text")))
    joined = joined.withColumn("__new", counted(chunks(t, divisor)))
    return joined.select(*[(F.col("__new.text") if c == text_col else F.col("__row").getField(c)).alias(c) for c in rest], F.coalesce("__new.lines", F.lit(0)).cast("long").alias("n_lines"),
                         F.when(t.isNull(), 0).otherwise(F.col("__new.n")).cast("long").alias("n_chunks"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed_lines"))


def windows(text: Column, words: int = LONE_WORDS) -> Column:
    """array<struct<pos, lines, body>>: pairs of neighbouring lines that hold a word, and lines of
    ``words`` words or more; null for a null text."""
    one = lambda body, pos, n: F.struct(pos.cast("long").alias("pos"), F.lit(n).cast("long").alias("lines"), body.alias("body"))

    def found(lines: Column) -> Column:
        rest = F.size(lines) - 1
        pairs = F.zip_with(F.slice(lines, F.lit(1), rest), F.slice(lines, F.lit(2), rest), lambda a, b: F.concat_ws("\n", a, b))
        pairs = F.filter(F.transform(pairs, lambda b, i: one(b, i, 2)), lambda w: F.rlike(w["body"], F.lit(r"[^\x20\x09-\x0D]")))
        lone = F.filter(F.transform(lines, lambda b, i: one(b, i, 1)), lambda w: F.regexp_count(w["body"], F.lit(r"[^\x20\x09-\x0D]+")) >= words)
        return F.concat(pairs, lone)

    return F.when(text.isNotNull(), let(F.split(text, "\n", -1), found))


def dedup_runs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = LONE_WORDS) -> DataFrame:
    """``docs`` without its repeated runs of lines in ``text_col``, plus ``n_lines`` and
    ``removed_lines`` (columns of these names are replaced).

    A run is two neighbouring lines or more, or one line of ``words`` words. A line goes when
    it stands in a run that occurred before (by id, nulls last, then position) and in no run
    that occurs again later and stands there first: the first occurrence of every run stays
    whole. Other defined cases as in ``dedup_lines``.
    """
    prepare_session(spark)
    text, id_ = F.col(text_col), F.col(id_col).cast("long")
    rid = F.xxhash64(id_, text)
    key = ["k1", "k2", "lines"]
    each = docs.select(id_.alias("id"), rid.alias("rid"), F.explode(windows(text, words)).alias("w")).select("id", "rid", "w.pos", "w.lines", "w.body", F.xxhash64("w.body").alias("k1"), F.xxhash64(F.lit(17), "w.body").alias("k2"))
    keys = cut(each.drop("body"), "run-keys")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid", "pos")
    again = cut(keys.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select(*key, "first"), "runs-again")
    # the bytes of every repeated run: equal hashes must mean equal bodies
    bodies = each.join(small(again.select(*key), 24), key, "left_semi")
    alike = cut(bodies.groupBy(*key).agg((F.min("body") == F.max("body")).alias("alike")), "runs-alike")
    seen = keys.join(small(again.join(alike.where("alike"), key), 80), key).select("rid", "pos", "lines", (place == F.col("first")).alias("stays"))
    if not alike.where("not alike").isEmpty():  # different bodies under one hash: compare the bodies themselves
        odd = bodies.join(alike.where("not alike"), key, "left_semi")
        first = odd.groupBy(*key, "body").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
        seen = seen.unionByName(odd.join(first, [*key, "body"]).select("rid", "pos", "lines", (place == F.col("first")).alias("stays")))
    seen = seen.select("rid", "stays", F.explode(F.sequence("pos", F.col("pos") + F.col("lines") - 1)).alias("pos"))
    seen = seen.groupBy("rid", "pos").agg(F.max("stays").alias("stays")).where("not stays")
    gone = cut(seen.groupBy("rid").agg(F.collect_list("pos").alias("gone")).withColumnRenamed("rid", "__rid"), "runs-gone")
    rest = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    joined = docs.select(F.struct(*[F.col(c) for c in rest]).alias("__row"), rid.alias("__rid")).join(gone, "__rid", "left")
    t = F.col("__row").getField(text_col)
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col("gone")), lambda i: F.get(lines, i.cast("int")))
    new = F.when(F.col("gone").isNull(), t).otherwise(let(F.split(t, "\n", -1), lambda lines: F.array_join(left(lines), "\n")))
    return joined.select(*[(new if c == text_col else F.col("__row").getField(c)).alias(c) for c in rest],
                         F.coalesce(F.size(F.split(t, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("removed_lines"))


def q_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without repeated multi-line chunks."""
    return dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_chunks", "removed_lines")


SQL_LINE_CHUNKS = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v FROM l),
r AS (SELECT *, (coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0) * {FACTOR} + v) % {DIVISOR} = 0 AS last FROM h),
p AS (SELECT *, coalesce(sum(CAST(last AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r),
c AS (SELECT doc_id, pos, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM p GROUP BY doc_id, pos),
d AS (SELECT *, lines >= {LEAST} AND row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1 AS gone FROM c)
SELECT doc.doc_id, CASE WHEN doc.text IS NULL THEN NULL ELSE coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') END AS text,
  CAST(coalesce(sum(lines), 0) AS BIGINT) AS n_lines, count(pos) AS n_chunks, CAST(coalesce(sum(lines) FILTER (WHERE gone), 0) AS BIGINT) AS removed_lines
FROM documents doc LEFT JOIN d ON d.doc_id = doc.doc_id GROUP BY doc.doc_id, doc.text
"""
