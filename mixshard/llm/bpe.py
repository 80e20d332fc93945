"""BPE encoding and decoding with a pair occurrence index (operator 8).

A task keeps the distinct words of a piece of its partition as one linked array of
symbols. An index maps every mergeable pair to all its positions; active ranks are taken
in ascending order, each is applied to all positions of its pair at once, and the lists
of the neighbouring pairs are extended. A merge creates a symbol that no earlier rank
uses, so one ascending pass gives what merging word by word would.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm import text as T
from mixshard.llm import vocab
from mixshard.session import prepare_session

#: Bytes of text whose distinct words share one index.
INDEX_BYTES = 12 << 20

# White space of the pattern language of the tokenizer file
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(f"[^{_SPACE}]+")
_NO_SPACE = regex.compile("[\x1c-\x1f]")

# Lower case of letters that Unicode assigned after Python's tables
_NEWER_LOWER = str.maketrans({
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B})
# Letters and digits of the tokenizer's Unicode version that Python's tables lack
_NEWER_CHARS = {c for lo, hi in [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA)] for c in map(chr, range(lo, hi + 1))}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder of a word-level BPE file (JSON of the ``tokenizers`` library)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        ids, chars = model["vocab"], byte_chars()
        if spec.get("decoder") is not None or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("unsupported tokenizer file: a decoder, byte fallback or ignored merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        n = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * n
        for t, i in chain(ids.items(), self.special.items()):
            self.tokens[i] = t
        self.digits = [str(i) for i in range(n)]
        self.plain = np.array([ids[c] for c in chars], np.int32)
        self.last = np.array([ids[c + suffix] for c in chars], np.int32)
        self.n = np.int64(n)
        left = np.array([ids[a] for a, _ in model["merges"]], np.int64)
        right = np.array([ids[b] for _, b in model["merges"]], np.int64)
        self.made = np.array([ids[a + b] for a, b in model["merges"]], np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        key = left * self.n + right
        order = np.lexsort((np.arange(len(key)), key))
        first = np.ones(len(key), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        self.rank = order[first].astype(np.int32)
        self.key = key[order][first]

    # --- encoding

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], -1)

    def pre_tokens(self, word: str) -> list[str | int]:
        """Pieces of one white-space-free word; special tokens as their ids."""
        if self.special_re is not None and "<" in word:
            out, at = [], 0
            for m in self.special_re.finditer(word):
                out += self._pieces(word[at: m.start()])
                out.append(self.special[m.group()])
                at = m.end()
            return out + self._pieces(word[at:])
        return self._pieces(word)

    def _pieces(self, word: str) -> list[str]:
        if not word.isascii():
            # character by character, as the tokenizer lower-cases: no final sigma
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower().translate(_NEWER_LOWER)
            # code points without a category are neither letters nor digits in the pattern
            known = "".join("\uffff" if unicodedata.category(c) == "Cn" and c not in _NEWER_CHARS else c for c in word)
            return [word[m.start(): m.end()] for m in self.pieces.finditer(known)]
        return self.pieces.findall(word.lower())

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ends = np.cumsum(size)
        sym = np.empty(n + 1, np.int32)
        sym[:n] = self.plain[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        sym[n] = -1
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[ends - 1] = n
        prv[ends - size] = n
        nxt[n] = n
        # the index: positions of every pair, by rank
        rank = self.ranks(sym[:n], sym[nxt[:n]])
        at = np.flatnonzero(rank >= 0).astype(np.int32)
        at = at[np.argsort(rank[at], kind="stable")]
        bounds = np.flatnonzero(np.diff(rank[at], prepend=-1))
        lists = {int(r): [p] for r, p in zip(rank[at][bounds], np.split(at, bounds[1:]))}
        del rank, at
        active = list(lists)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = self.left[r], self.right[r], self.made[r]
            held = lists.pop(r)
            pos = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # runs: every second position, from the left
                start = np.ones(len(pos), bool)
                start[1:] = nxt[pos[:-1]] != pos[1:]
                i = np.arange(len(pos))
                pos = pos[(i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone] = c, -2
            nxt[pos] = after
            prv[after] = pos
            before = prv[pos]
            where = np.concatenate([pos, before])
            new = np.concatenate([self.ranks(sym[pos], sym[after]), self.ranks(sym[before], sym[pos])])
            keep = np.flatnonzero(new >= 0)
            if not len(keep):
                continue
            where, new = where[keep], new[keep]
            if len(new) > 1:
                order = np.argsort(new, kind="stable")
                where, new = where[order], new[order]
                cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
                groups = zip(new[np.append(0, cuts)].tolist(), np.split(where, cuts)) if len(cuts) else [(int(new[0]), where)]
            else:
                groups = [(int(new[0]), where)]
            for k, p in groups:
                if k in lists:
                    lists[k].append(p)
                else:
                    lists[k] = [p]
                    heapq.heappush(active, k)
        alive = sym[:n] >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive], total[ends] - total[ends - size]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text). Null and empty texts have no ids."""
        code: dict[str, int] = {}
        rows = []
        for t in texts:
            parts = [] if not t else _SPLIT.findall(t) if _NO_SPACE.search(t) else t.split()
            rows.append(np.fromiter((code.setdefault(w, len(code)) for w in parts), np.int32, len(parts)))
        # distinct pre-tokens of the distinct words
        piece: dict[str, int] = {}
        fixed: list[int] = []
        per_word, flat = np.zeros(len(code), np.int64), []
        for i, w in enumerate(code):
            found = self.pre_tokens(w)
            per_word[i] = len(found)
            for p in found:
                if isinstance(p, int):
                    fixed.append(p)
                    flat.append(-len(fixed))
                else:
                    flat.append(piece.setdefault(p, len(piece)))
        ids, count = self.merge([p.encode() for p in piece]) if piece else (np.empty(0, np.int32), np.empty(0, np.int64))
        first = np.cumsum(count) - count
        flat_a = np.array(flat, np.int64)
        special = flat_a < 0
        ids = np.concatenate([ids, np.array(fixed, np.int32)])
        base = len(ids) - len(fixed)
        start = np.where(special, base - flat_a - 1, np.append(first, 0)[np.where(special, len(first), flat_a)])
        length = np.where(special, 1, np.append(count, 0)[np.where(special, len(count), flat_a)])
        # ids of every distinct word, then of every text
        word_ids = ids[_ranges(start, length)]
        ends = np.concatenate([[0], np.cumsum(length)])
        word_end = np.cumsum(per_word)
        w_start, w_len = ends[word_end - per_word], ends[word_end] - ends[word_end - per_word]
        all_codes = np.concatenate(rows) if rows else np.empty(0, np.int32)
        out = word_ids[_ranges(w_start[all_codes], w_len[all_codes])]
        total = np.concatenate([[0], np.cumsum(w_len[all_codes])])
        row_end = np.cumsum([len(r) for r in rows]).astype(np.int64)
        per_row = total[row_end] - total[row_end - np.array([len(r) for r in rows], np.int64)]
        return out, per_row

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones included; ids outside the vocabulary are left out."""
        n = len(self.tokens)
        if ids and (min(ids) < 0 or max(ids) >= n):
            ids = [i for i in ids if 0 <= i < n]
        return " ".join(map(self.tokens.__getitem__, ids))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., for ``length[0]`` items, then the next."""
    length = length.astype(np.int64)
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)


@lru_cache(maxsize=2)
def _tokenizer(data: bytes) -> PairIndexBPE:
    return PairIndexBPE(data)


def _file(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(vocab.read_file(path or vocab.default_path("word_bpe_49k.json")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts, joined up to INDEX_BYTES so that their distinct words share one index."""
    held, size = [], 0
    for b in T.slices(batches, "text", INDEX_BYTES):
        held.append(b)
        size += len(T.flat(b.column(1))[0])
        if size >= INDEX_BYTES // 2:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, list]:
    t = pa.Table.from_batches(held).combine_chunks()
    return t.column(0).combine_chunks() if t.num_rows else t.column(0), [x for c in t.column(1).chunks for x in c.to_pylist()]


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def encode(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>): one row per input row, without special tokens added.

    Null and empty texts have no ids; null ids stay null; repeated rows are repeated;
    other columns are not read; an empty table gives an empty result. ``path`` is a
    tokenizer file, by default the installed public ``word_bpe_49k.json``."""
    prepare_session(spark)
    data = _file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(data.value)
        for who, texts in _pieces(batches):
            ids, per = bpe.encode(texts)
            off = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], names=["id", "ids"])

    return _input(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")


def decode(spark: SparkSession, rows: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): tokens of the ids joined by one space. Null ids arrays give an empty text;
    null elements and ids outside the vocabulary are left out."""
    prepare_session(spark)
    data = _file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(data.value)
        for b in batches:
            texts = [bpe.decode([i for i in x if i is not None] if x else []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")


def round_trip(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, digests only.

    The same batch functions as ``encode`` and ``decode``; cases as there."""
    prepare_session(spark)
    data = _file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(data.value)
        name = bpe.digits.__getitem__
        for who, texts in _pieces(batches):
            ids, per = bpe.encode(texts)
            del texts
            off, a, b = np.concatenate([[0], np.cumsum(per)]), [], []
            for i in range(len(per)):
                own = ids[off[i]: off[i + 1]].tolist()
                a.append(hashlib.sha256(" ".join(map(name, own)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(per, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def q_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded."""
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
