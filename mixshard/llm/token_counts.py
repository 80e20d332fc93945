"""Token counts by a trie-shared unigram programme (operator 1).

The distinct pre-tokens of a piece of a partition are put in a trie, level by level. A
node's forward score (best sum of piece scores over segmentations of its prefix) is
computed once for all pre-tokens that share the prefix; the count at a pre-token's
terminal node is its number of tokens.

Scores: the public piece vocabulary lists its pieces by frequency; a piece of rank r has
the Zipf log probability -ln(r + 1). A character without a piece costs one byte token
per UTF-8 byte, each ten below the lowest score. Equal scores: the shorter last piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm import text as T
from mixshard.llm import vocab
from mixshard.session import prepare_session

#: Put before every pre-token, as the vocabulary's pieces expect.
MARK = "▁"
#: Pre-tokens longer than this are walked alone (same recurrence): a level of the trie
#: would hold just them.
TRIE_DEPTH = 192


class Unigram:
    """Piece scores, by length, for array and scalar lookups."""

    def __init__(self, pieces: list[str]):
        self.score = {}
        for r, p in enumerate(pieces):
            self.score.setdefault(p, -float(np.log(r + 1.0)))
        self.byte = min(self.score.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.score), default=1)
        self.tables = {}
        for k in range(1, self.longest + 1):
            own = [p for p in self.score if len(p) == k]
            if own:
                h = np.array([_hash(p) for p in own], np.uint64)
                order = np.argsort(h)
                self.tables[k] = (h[order], np.array([self.score[p] for p in own])[order])

    def lookup(self, k: int, h: np.ndarray) -> np.ndarray:
        """Scores of pieces of length k by hash; -inf where there is none."""
        keys, scores = self.tables[k]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, scores[at], -np.inf)

    def count_one(self, word: str) -> int:
        """Tokens of one pre-token, by the plain recurrence."""
        best, count = [0.0], [0]
        for i in range(1, len(word) + 1):
            s, c = -np.inf, 0
            for k in range(1, min(i, self.longest) + 1):
                v = self.score.get(word[i - k: i])
                if v is not None and best[i - k] + v > s:
                    s, c = best[i - k] + v, count[i - k] + 1
                elif v is None and k == 1:
                    n = len(word[i - 1].encode())
                    s, c = best[i - 1] + n * self.byte, count[i - 1] + n
            best.append(s)
            count.append(c)
        return count[-1]

    def count_all(self, points: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of every pre-token; ``points`` are their code points one after the other."""
        out = np.zeros(len(length), np.int64)
        start = np.cumsum(length) - length
        long = np.flatnonzero(length > TRIE_DEPTH)
        for i in long:
            out[i] = self.count_one(points[start[i]: start[i] + length[i]].astype("<u4").tobytes().decode("utf-32-le"))
        live = np.flatnonzero((length > 0) & (length <= TRIE_DEPTH))
        node = np.zeros(len(live), np.int64)  # each pre-token's node at the current level
        levels = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64))]  # score, count, hash, parent
        depth = 0
        while len(live):
            char = points[start[live] + depth].astype(np.int64)
            key, node = np.unique((node << 21) | char, return_inverse=True)
            parent, char = key >> 21, key & 0x1FFFFF
            score, count, h, _ = levels[-1]
            own = h[parent] * _B + (char.astype(np.uint64) + np.uint64(1))
            best, number = np.full(len(key), -np.inf), np.zeros(len(key), np.int64)
            up = parent
            for k in range(1, min(depth + 1, self.longest) + 1):
                before, so_far, h, older = levels[-k]
                if k in self.tables:
                    s = self.lookup(k, T.mix(own - h[up] * _POWERS[k]))
                    if k == 1:
                        bytes_ = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
                        single = np.isinf(s)
                        s = np.where(single, bytes_ * self.byte, s)
                        add = np.where(single, bytes_, 1)
                    else:
                        add = 1
                    total = before[up] + s
                    better = total > best
                    best = np.where(better, total, best)
                    number = np.where(better, so_far[up] + add, number)
                up = older[up]
            levels.append((best, number, own, parent))
            if len(levels) > self.longest:
                levels.pop(0)
            depth += 1
            done = length[live] == depth
            out[live[done]] = number[node[done]]
            live, node = live[~done], node[~done]
        return out


_B = np.uint64(0xD1342543DE82EF95)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(512, _B, np.uint64)]))


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_B) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return int(T.mix(np.array([h], np.uint64))[0])


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, most frequent first (unknown, control and
    byte pieces left out)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=vocab.read_file(path))
    keep = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in sorted(keep, key=lambda i: -sp.get_score(i))]


@lru_cache(maxsize=2)
def _model(pieces: tuple[str, ...]) -> Unigram:
    return Unigram(list(pieces))


def batch_counts(model: Unigram, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pre-tokens, tokens) of each document of a batch."""
    starts, ends, doc = T.words(buf, off)
    if not len(starts):
        z = np.zeros(len(off) - 1, np.int64)
        return z, z
    _, first, back = np.unique(T.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    lo, size = starts[first], ends[first] - starts[first]
    total = np.cumsum(size) - size
    raw = buf[np.arange(int(size.sum())) + np.repeat(lo - total, size)]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    length = np.add.reduceat(T.code_points(raw).astype(np.int64), total)
    # the mark before every pre-token
    at = np.cumsum(length) - length
    points = np.insert(points, at, ord(MARK))
    tokens = model.count_all(points, length + 1)[back]
    n = len(off) - 1
    return np.bincount(doc, minlength=n).astype(np.int64), np.bincount(doc, tokens, minlength=n).astype(np.int64)


def token_counts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens): one row per input row. Pre-tokens are white-space separated words.

    Null, empty and blank texts count zero; null ids stay null; repeated rows are repeated;
    other columns are not read; an empty table gives an empty result. ``path`` is a
    sentencepiece file, by default the installed public ``piece_bpe_32k.model``.
    """
    prepare_session(spark)
    data = spark.sparkContext.broadcast(tuple(load_pieces(path or vocab.default_path("piece_bpe_32k.model"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data.value)
        for b in T.slices(batches, "text"):
            n_words, n_tokens = batch_counts(model, *T.flat(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n_tokens)], names=["id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_words long, n_tokens long")


def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents``."""
    return token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
