"""Language identification with a byte convolutional network (operator 5).

Bytes are embedded, filters of several widths slide over fixed-length windows, each
filter keeps its largest response and a softmax layer names the language. The network is
trained in numpy on the driver from a bounded sample of labelled texts (see
``SAMPLE_PER_LANG``); prediction runs over every window of every whole text in Arrow
batches. A document's score is the mean probability over its windows, weighted by their
letters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mixshard.llm import text as T
from mixshard.session import prepare_session

WINDOW = 256
#: Expected number of labelled texts a language gives to training, at most (documented bound of
#: the fit; texts are chosen by a hash of their id), and windows that one text gives, drawn
#: from all of it.
SAMPLE_PER_LANG, SAMPLE_WINDOWS = 1200, 6
#: More labels than this are refused: the labels are not languages then.
MOST_LANGS = 512
EMBED, FILTERS, WIDTHS = 8, 24, (2, 3, 4)
EPOCHS, BATCH, RATE, SEED = 6, 64, 5e-3, 11

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class ByteCNN:
    """Embedding, one filter bank per width, max pooling, softmax."""

    def __init__(self, langs: list[str], rng: np.random.Generator):
        self.langs = langs
        self.wide = max(WIDTHS)
        f = FILTERS * len(WIDTHS)
        self.emb = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.emb[0] = 0  # padding
        # one matrix for all widths: narrower filters have zero rows
        self.live = np.zeros((self.wide * EMBED, f), np.float32)
        for i, w in enumerate(WIDTHS):
            self.live[: w * EMBED, i * FILTERS: (i + 1) * FILTERS] = 1
        self.filt = (rng.normal(0, 1 / np.sqrt(self.wide * EMBED), self.live.shape) * self.live).astype(np.float32)
        self.bias = np.zeros(f, np.float32)
        self.out = rng.normal(0, 0.1, (f, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _unfold(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, wide * EMBED): embedded bytes around every position."""
        e = np.zeros((len(x), x.shape[1] + self.wide - 1, EMBED), np.float32)
        e[:, : x.shape[1]] = self.emb[x]
        n, p, d = e.shape
        s = e.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (n, x.shape[1], self.wide * d), (s[0], s[1], s[2])))

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = self._unfold(x)
        n, p, k = u.shape
        r = (u.reshape(-1, k) @ self.filt).reshape(n, p, -1)
        return u, r

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax over the languages for each window (rows of bytes, 0 is padding)."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), 128):
            _, r = self._pool(x[i: i + 128])
            h = np.maximum(r.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
            h -= h.max(axis=1, keepdims=True)
            e = np.exp(h)
            out[i: i + 128] = e / e.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross entropy; labels weigh alike whatever their number of windows."""
        weight = 1.0 / np.maximum(np.bincount(y, minlength=len(self.langs)), 1)[y]
        weight = (weight / weight.mean()).astype(np.float32)
        names = ("emb", "filt", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, steps = 0, EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                at = order[i: i + BATCH]
                g = self._gradients(x[at], y[at], weight[at])
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * step / (steps + 1)))
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32))

    def _gradients(self, x, y, weight) -> dict[str, np.ndarray]:
        u, r = self._pool(x)
        n, p, k = u.shape
        best = r.argmax(axis=1)  # (n, filters)
        top = np.take_along_axis(r, best[:, None, :], 1)[:, 0] + self.bias
        h = np.maximum(top, 0)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d *= weight[:, None] / n
        back = (d @ self.out.T) * (top > 0)
        seen = u[np.arange(n)[:, None], best]  # (n, filters, k): what each winning position saw
        g_filt = np.einsum("nf,nfk->kf", back, seen, optimize=True) * self.live
        g_seen = back[:, :, None] * self.filt.T[None]
        g_emb = np.zeros_like(self.emb)
        padded = np.concatenate([x, np.zeros((n, self.wide - 1), x.dtype)], 1)
        for w in range(self.wide):
            np.add.at(g_emb, padded[np.arange(n)[:, None], best + w].ravel(), g_seen[:, :, w * EMBED: (w + 1) * EMBED].reshape(-1, EMBED))
        g_emb[0] = 0
        return {"emb": g_emb, "filt": g_filt, "bias": back.sum(0), "out": h.T @ d, "out_bias": d.sum(0)}


def cut_windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of WINDOW bytes, document of each): whole texts, the last window padded by 0."""
    size = np.diff(off)
    per = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), per)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    lo = off[doc] + first * WINDOW
    at = lo[:, None] + np.arange(WINDOW)
    inside = at < off[doc + 1][:, None]
    return np.where(inside, buf[np.minimum(at, max(len(buf) - 1, 0))], 0) if len(doc) else np.empty((0, WINDOW), np.uint8), doc


def training_windows(raw: bytes, who: str) -> np.ndarray:
    """Windows from all over a text, drawn by its id; half of them cut short, as short texts are."""
    rng, raw = np.random.default_rng([SEED, zlib.crc32(who.encode())]), np.frombuffer(raw, np.uint8)
    rows = np.zeros((min(SAMPLE_WINDOWS, 1 + len(raw) // 200), WINDOW), np.uint8)
    for row in rows:
        n = WINDOW if rng.random() < 0.5 else int(rng.integers(16, WINDOW))
        lo = int(rng.integers(0, max(1, len(raw) - n + 1)))
        part = raw[lo: lo + n]
        row[: len(part)] = part
    return rows


def train(texts: list[str], labels: list[str]) -> ByteCNN | None:
    """A network trained on labelled texts; None without any."""
    return train_windows([(lang, training_windows(t.encode(), str(i))) for i, (t, lang) in enumerate(zip(texts, labels))])


def train_windows(samples: list[tuple[str, np.ndarray]]) -> ByteCNN | None:
    """A network trained on (label, windows of one text)."""
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    net = ByteCNN(langs, rng)
    x = np.concatenate([w for _, w in samples])
    y = np.repeat(np.searchsorted(langs, [lang for lang, _ in samples]), [len(w) for _, w in samples])
    if len(langs) > 1 and len(x):
        net.fit(x, y, rng)
    return net


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """Fit on a bounded sample of ``docs`` (rows with a label and a text): about
    SAMPLE_PER_LANG texts of each label, chosen by a hash of the id. Their windows are drawn
    from the whole texts on the executors; only windows reach the driver."""
    prepare_session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of {lang_col}")
    if not sizes:
        return None
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_PER_LANG / n)))])
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(draw < share[F.col("lang")]).select(F.coalesce("id", F.lit("")).alias("id"), "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            who = b.column(0).to_pylist()
            buf, off = T.flat(b.column(1))
            found = [training_windows(buf[off[i]: off[i + 1]].tobytes(), w).tobytes() for i, w in enumerate(who)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], names=["id", "windows", "lang"])

    got = chosen.mapInArrow(run, "id string, windows binary, lang string").limit(2 * SAMPLE_PER_LANG * len(sizes)).toLocalIterator()
    samples = sorted((r["lang"], r["id"], bytes(r["windows"])) for r in got)
    return train_windows([(lang, np.frombuffer(w, np.uint8).reshape(-1, WINDOW)) for lang, _, w in samples])


def batch_predict(net: ByteCNN | None, buf: np.ndarray, off: np.ndarray, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text of a batch."""
    n = len(off) - 1
    letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
    if net is None:
        return ["und"] * n, np.zeros(n)
    rows, doc = cut_windows(buf, off)
    weight = _LETTERS[rows].sum(axis=1) + 1e-3
    used = letters[doc] if len(doc) else np.empty(0, bool)
    total = np.zeros((n, len(net.langs)))
    np.add.at(total, doc[used], net.probabilities(rows[used]) * weight[used, None])
    share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
    best = share.argmax(axis=1)
    return [net.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, np.clip(share[np.arange(n), best], 0, 1), 0.0)


def identify(spark: SparkSession, docs: DataFrame, net: ByteCNN | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (columns of these names are
    replaced): one row per input row, over every window of the whole text.

    ``und`` with score 0: text null, empty or without a letter, or nothing was learned.
    Repeated rows are repeated; other columns are not read; an empty table gives an empty
    result.
    """
    prepare_session(spark)
    data = spark.sparkContext.broadcast(net)  # a few thousand weights
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*rest)
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, text_col, 1 << 20):
            texts = b.column(rest.index(text_col))
            lang, score = batch_predict(data.value, *T.flat(texts), texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*rest, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def predict(spark: SparkSession, docs: DataFrame, net: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, as ``identify``; null ids stay null."""
    return identify(spark, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), net).select("id", "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for ids whose crc32 (of the id as text) leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def q_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``; learned from the documents not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = learn(docs.where(~held_out()))
    return predict(spark, docs, net).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
