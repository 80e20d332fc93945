"""Byte-level BPE by corpus-level merge replay (operator 12).

The distinct pre-tokens of a piece of the corpus are one linked array of symbols, one a
byte at first. An inverted index leads from the rank of a token pair to all its positions
in those words; ranks are applied in order, each to all its positions at once, and only the
pairs of the touched neighbours are looked up again and entered in the index.

A rank file names tokens, not merges: a pair has the rank of the token that its bytes spell.
A merge may therefore open a pair of a *lower* rank, which then has its turn next, as it has
in a word taken by itself. Where such a pair opens in a word that holds the present pair once
more further right, order inside the word matters, and that word is replayed alone, lowest
rank first and leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm import text as T
from mixshard.llm import vocab
from mixshard.llm.bpe import _NEWER_CHARS, _ranges
from mixshard.session import prepare_session

#: Bytes of text whose distinct pre-tokens share one index.
INDEX_BYTES = 12 << 20
#: Characters below this are matched by explicit classes (half the time of the property classes).
FEW_CHARS = 0x250


class Splitter:
    """Pre-tokens of a text: the matches of a tiktoken pattern.

    Letters and digits are those of the Unicode version of the pattern's own library; code
    points that only the installed ``regex`` knows are neither."""

    def __init__(self, pattern: str):
        self.all = regex.compile(pattern)
        chars = "".join(map(chr, range(FEW_CHARS)))
        inside = {k: "".join(f"\\u{ord(c):04x}" for c in regex.findall(k, chars)) for k in (r"\p{L}", r"\p{N}", r"\s")}
        few, bracket = [], False
        for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
            bracket = part == "[" or (bracket and part != "]")
            if part == r"\S":
                part = f"[^{inside[chr(92) + 's']}]"
            elif part in inside:
                part = inside[part] if bracket else f"[{inside[part]}]"
            few.append(part)
        self.few = re.compile("".join(few))
        self.more = re.compile(f"[^\\x00-{chr(FEW_CHARS - 1)}]")
        self._unknown: set[str] | None = None

    def unknown(self) -> set[str]:
        """Letters and digits that only the installed ``regex`` knows."""
        if self._unknown is None:
            newer = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and c not in _NEWER_CHARS)
            self._unknown = set(regex.findall(r"[\p{L}\p{N}]", newer))
        return self._unknown

    def __call__(self, t: str) -> list[str]:
        if not self.more.search(t):
            return [m for m in self.few.findall(t) if m]
        if self.unknown().isdisjoint(t):
            return [m for m in self.all.findall(t) if m]
        known = t.translate(dict.fromkeys(map(ord, self.unknown().intersection(t)), "\uffff"))
        return [t[m.start(): m.end()] for m in self.all.finditer(known) if m.end() > m.start()]


class MergeReplay:
    """Encoder and decoder of a rank file (``base64(token) rank`` a line) and a pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.n = np.int64(max(self.rank_of.values()) + 1)
        self.tokens = [b""] * int(self.n)
        for t, r in self.rank_of.items():
            self.tokens[r] = t
        if any(bytes([b]) not in self.rank_of for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.byte = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        self.split = Splitter(pattern)
        # every pair of tokens that spells a token
        get, key, rank = self.rank_of.get, [], []
        for t, r in self.rank_of.items():
            for i in range(1, len(t)):
                a = get(t[:i])
                if a is not None and (b := get(t[i:])) is not None:
                    key.append(a * int(self.n) + b)
                    rank.append(r)
        order = np.argsort(np.array(key, np.int64))
        self.key, self.rank = np.array(key, np.int64)[order], np.array(rank, np.int32)[order]
        # ranks whose token is part of a token of a lower rank
        self.opens_lower = np.zeros(int(self.n), bool)
        for part in (self.key // self.n, self.key % self.n):
            self.opens_lower[part[part > self.rank]] = True

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where its bytes spell no token."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(raw), np.cumsum(size)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        sym = np.append(self.byte[raw], np.int32(-1))
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[ends - 1] = prv[ends - size] = nxt[n] = n  # n: beyond the word
        rank = self.ranks(sym[:n], sym[nxt[:n]])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        at = np.flatnonzero(rank >= 0).astype(np.int32)
        self._enter(index, active, rank[at], at)
        del rank, at
        alone: list[int] = []
        while active:
            r = heapq.heappop(active)
            held = index.pop(r)
            pos = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            pos = pos[self.ranks(sym[pos], sym[nxt[pos]]) == r]
            if not len(pos):
                continue
            if len(pos) > 1:  # overlapping pairs: every second one, from the left
                start = np.append(True, nxt[pos[:-1]] != pos[1:])
                i = np.arange(len(pos))
                pos = pos[(i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0]
            if self.opens_lower[r] and len(pos) > 1:
                out = self._order_matters(r, pos, sym, nxt, prv, word)
                if len(out):
                    alone += out.tolist()
                    for w in out:
                        sym[ends[w] - size[w]: ends[w]] = -3
                    pos = pos[sym[pos] >= 0]
                    if not len(pos):
                        continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone] = r, -2
            nxt[pos] = after
            prv[after] = pos
            before = prv[pos]
            where = np.concatenate([pos, before])
            new = np.concatenate([self.ranks(sym[pos], sym[after]), self.ranks(sym[before], sym[pos])])
            keep = np.flatnonzero(new >= 0)
            self._enter(index, active, new[keep], where[keep])
        alive = sym[:n] >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        per = total[ends] - total[ends - size]
        if not alone:
            return sym[:n][alive], per
        found = {w: self._replay_one(words[w]) for w in alone}
        for w, ids in found.items():
            per[w] = len(ids)
        first = np.cumsum(per) - per
        out = np.empty(int(per.sum()), np.int32)
        rest = np.ones(len(words), bool)
        rest[list(found)] = False
        out[_ranges(first[rest], per[rest])] = sym[:n][alive]
        for w, ids in found.items():
            out[first[w]: first[w] + len(ids)] = ids
        return out, per

    @staticmethod
    def _enter(index: dict, active: list, rank: np.ndarray, at: np.ndarray) -> None:
        """Positions added to the lists of their ranks."""
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, p in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts)):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(active, r)

    def _order_matters(self, r: int, pos: np.ndarray, sym, nxt, prv, word) -> np.ndarray:
        """Words in which merging one of ``pos`` opens a pair below ``r`` before a later one's turn."""
        gone = nxt[pos]
        left = sym[prv[pos]].copy()
        left[1:][prv[pos[1:]] == gone[:-1]] = r  # the neighbour on the left has merged by then
        made = np.full(len(pos), r, np.int32)
        a, b = self.ranks(left, made), self.ranks(made, sym[nxt[gone]])
        opens = ((a >= 0) & (a < r)) | ((b >= 0) & (b < r))
        return np.unique(word[pos[:-1]][opens[:-1] & (word[pos[1:]] == word[pos[:-1]])])

    def _replay_one(self, w: bytes) -> list[int]:
        """One word by itself: the lowest rank, the leftmost pair, again and again."""
        ids = self.byte[np.frombuffer(w, np.uint8)].tolist()
        n, tokens, get = len(ids), self.tokens, self.rank_of.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(tokens[ids[i]] + tokens[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
            for x, y in ((prv[i], i), (i, k)):
                if x >= 0 and y < n and (q := get(tokens[ids[x]] + tokens[ids[y]])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text). Null and empty texts have no ids."""
        code: dict[str, int] = {}
        rows = []
        for t in texts:
            parts = self.split(t) if t else []
            rows.append(np.fromiter((code.setdefault(w, len(code)) for w in parts), np.int32, len(parts)))
        words = [w.encode() for w in code]
        del code
        whole = np.fromiter((self.rank_of.get(w, -1) for w in words), np.int32, len(words))  # a word that is a token stays one
        other = np.flatnonzero(whole < 0)
        merged, count = self.replay([words[i] for i in other]) if len(other) else (np.empty(0, np.int32), np.empty(0, np.int64))
        per = np.ones(len(words), np.int64)
        per[other] = count
        first = np.cumsum(per) - per
        ids = np.empty(int(per.sum()), np.int32)
        ids[first[whole >= 0]] = whole[whole >= 0]
        ids[_ranges(first[other], count)] = merged
        length = np.array([len(r) for r in rows], np.int64)
        codes = np.concatenate(rows) if rows else np.empty(0, np.int32)
        total = np.concatenate([[0], np.cumsum(per[codes])])
        end = np.cumsum(length)
        return ids[_ranges(first[codes], per[codes])], total[end] - total[end - length]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; ids outside the vocabulary are left out."""
        return b"".join([self.tokens[i] for i in ids if 0 <= i < len(self.tokens)])


@lru_cache(maxsize=2)
def _tokenizer(data: bytes, pattern: str) -> MergeReplay:
    return MergeReplay(data, pattern)


def _shipped(spark: SparkSession, path: str | None, pattern: str | None):
    """(broadcast rank file, pattern): the file has a checked size."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return spark.sparkContext.broadcast(vocab.read_file(path or vocab.default_path("byte_bpe_multi_50k.tiktoken"))), pattern


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts, joined up to INDEX_BYTES so that their distinct words share one index."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined():
        t = pa.Table.from_batches(held)
        return pa.chunked_array(t.column(0).chunks, pa.int64()).combine_chunks(), t.column(1).to_pylist()

    for b in T.slices(batches, "text", INDEX_BYTES):
        held.append(b)
        size += len(T.flat(b.column(1))[0])
        if size >= INDEX_BYTES // 2:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def encode_bytes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>): one row per input row, special tokens' strings as ordinary text.

    Null and empty texts have no ids; null ids stay null; repeated rows are repeated; other
    columns are not read; an empty table gives an empty result; a text is taken whole,
    however long. ``path`` is a rank file, by default the installed public
    ``byte_bpe_multi_50k.tiktoken`` with its ``pattern``."""
    prepare_session(spark)
    data, pat = _shipped(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(data.value, pat)
        for who, texts in _groups(batches):
            ids, per = bpe.encode(texts)
            off = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([who, pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], names=["id", "ids"])

    return _input(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")


def decode_bytes(spark: SparkSession, rows: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, data binary): the bytes of the ids. Null arrays give no bytes; null elements and
    ids outside the vocabulary are left out."""
    prepare_session(spark)
    data, pat = _shipped(spark, path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(data.value, pat)
        for b in batches:
            out = [bpe.decode([i for i in x if i is not None] if x else []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "data"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id long, data binary")


def round_trip_bytes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                     pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, digests
    only. The batch functions of ``encode_bytes`` and ``decode_bytes``; cases as there."""
    prepare_session(spark)
    data, pat = _shipped(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(data.value, pat)
        for who, texts in _groups(batches):
            ids, per = bpe.encode(texts)
            del texts
            off, a, b = np.concatenate([[0], np.cumsum(per)]), [], []
            for i in range(len(per)):
                own = ids[off[i]: off[i + 1]]
                a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(own.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([who, pa.array(per, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def q_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded."""
    return round_trip_bytes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
