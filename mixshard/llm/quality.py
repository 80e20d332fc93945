"""Quality rules with zstandard compression bands (operator 10).

Base counts come from flat byte arrays. The verdict adds compression ratios: of the whole
document and of its fixed chunks, the last one a window that ends with the text, each
against limits for its length. Ratios below a band
mean repetitive text, above it incompressible text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm import text as T
from mixshard.session import prepare_session

LEVEL = 3
#: (least bytes, lowest ratio, highest ratio) of whole documents; the last row that fits holds.
#: Prose of several alphabets lies between 0.39 and 0.70 from 256 bytes on; short texts
#: compress worse because a frame has a fixed cost.
WHOLE_BANDS = [(0, 0.0, 9.0), (64, 0.35, 1.6), (128, 0.32, 1.0), (256, 0.28, 0.88), (512, 0.25, 0.82), (1024, 0.22, 0.76), (4096, 0.2, 0.74)]
#: (least bytes, chunk bytes, lowest, highest ratio of a chunk) of documents; the last row that
#: fits holds. Chunks of the given tables reach 0.55 at 2 KB (prose of other alphabets 0.70) and
#: 0.73 at 512 bytes, base64 starts at 0.77 and 0.84; shorter texts are one chunk, the whole.
CHUNK_BANDS = [(512, 512, 0.0, 0.8), (2048, 2048, 0.2, 0.73)]
#: A document goes when more than this share of its chunks is outside.
CHUNK_SHARE = 0.1

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, chunks long, chunks_outside long")


def base_counts(buf: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """Counts of each document of a batch (lines and windows are compared by 64-bit hash)."""
    n = len(off) - 1
    starts, ends, doc = T.words(buf, off)
    per = lambda d: np.bincount(d, minlength=n).astype(np.int64)
    # lines: cut at \n and at document borders
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    edge[1:][buf == 10] = True
    cut = np.flatnonzero(edge)
    lo, hi = cut[:-1], cut[1:]
    hi = hi - ((hi > lo) & (buf[np.maximum(hi - 1, 0)] == 10)) if len(lo) else hi
    inked = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~T.SPACES[buf], out=inked[1:])
    full = inked[hi] > inked[lo]
    lo, hi = lo[full], hi[full]
    owner = np.searchsorted(off, lo, side="right") - 1
    key = T.span_hashes(buf, lo, hi) + T.mix(owner.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    dup = per(owner) - per(owner[first])
    # words inside windows found twice or more in their document
    h = T.span_hashes(buf, starts, ends)
    grams = T.window_hashes(h, window)
    inside = doc[: len(grams)] == doc[window - 1:] if len(grams) else np.empty(0, bool)
    at = np.flatnonzero(inside)
    _, back, times = np.unique(grams[at] + T.mix(doc[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    hit = at[times[back] >= 2]
    cover = np.zeros(len(starts) + window + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    covered = np.cumsum(cover)[: len(starts)] > 0
    return {"n_words": per(doc), "word_chars": T.counts(T.code_points(buf) & ~T.SPACES[buf], off), "n_symbols": T.counts(_SYMBOLS[buf], off),
            "n_dup_lines": dup, "n_repeat_words": per(doc[covered])}


def bands(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio of the whole, chunks, chunks outside their band, verdict)."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(squeeze.compress(raw)) / len(raw)
    _, low, high = [b for b in WHOLE_BANDS if len(raw) >= b[0]][-1]
    chunks = outside = 0
    for _, size, least, most in [b for b in CHUNK_BANDS if len(raw) >= b[0]][-1:]:
        starts = [*range(0, len(raw) - size + 1, size), *([len(raw) - size] if len(raw) % size else [])]
        chunks = len(starts)
        outside = sum(not least <= len(squeeze.compress(raw[i: i + size])) / size <= most for i in starts)
    return ratio, chunks, outside, low <= ratio <= high and outside <= CHUNK_SHARE * chunks


def quality(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios and verdict of every document (see SCHEMA); one row per input row.

    ``base_failed``: fewer than 20 words, or more than 30 in 100 words repeat. ``kept``:
    not base_failed and every compression ratio lies in its band.
    Null and empty texts have zero counts and fail; null ids stay null; repeated rows are
    repeated; other columns are not read; an empty table gives an empty result.
    """
    prepare_session(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for b in T.slices(batches, "text"):
            buf, off = T.flat(b.column(1))
            c = base_counts(buf, off)
            found = [bands(buf[off[i]: off[i + 1]].tobytes(), squeeze) for i in range(len(off) - 1)]
            failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
            ok = np.array([f[3] for f in found], bool) & ~failed
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(ok),
                 pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
                names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every text of ``documents``."""
    return quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
