"""N-gram Jaccard join by prefix trees (operator 2).

1. ``shingle_sets``: every whole text becomes its set of distinct word n-grams, as
   sorted 64-bit hashes.
2. Documents with the same set are one class; the class is compared once.
3. Routing without loss. Two sets of at least the wanted similarity differ in at most H
   elements, H known from their sizes. The hash space is cut into more than H ranges, so
   some ranges hold exactly the same elements in both. Each class emits one signature per
   range; a class that shares too few of them with any others has no partner. Signatures are
   put in a global order, rarest first, and classes are chained by all but the most frequent
   that they could do without: the chains are the ``areas``. Common passages hardly meet
   here, for a range must agree as a whole.
4. Prefix-tree join inside each area: sets are stored in one global order in a radix
   tree, partial overlaps are shared by all sets below a node, and subtrees are pruned
   by what the remaining lengths can still reach. Subtrees already in the query's group
   are skipped, so a group of k near copies costs about k walks, not k^2.
5. An area above ``AREA_SETS`` is cut into blocks: blocks on their own, then one leader per
   group found, then all that is not in the area's largest group against every block.
   Nothing is capped: the last step compares whatever is not yet connected.
6. Connected components over classes, then membership of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixshard.llm import text as T
from mixshard.llm.columns import BROADCAST_BYTES, small
from mixshard.llm.graph import components, own_key as _own_key
from mixshard.session import cut, prepare_session

#: Sets in one tree at most (a larger area is cut into blocks that meet each other).
AREA_SETS = 128
#: Ratio of the size classes that share one number of hash ranges.
CLASS_RATIO = 1.4


def _doc_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document of a batch."""
    starts, ends, doc = T.words(buf, off)
    h = T.span_hashes(buf, starts, ends, lower=True)
    grams = T.window_hashes(h, n)
    first = np.searchsorted(doc, np.arange(len(off)))
    out = []
    for i in range(len(off) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= n:
            s = np.sort(grams[lo: hi - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:  # fewer words: the whole sequence is one element
            out.append(T.window_hashes(h[lo:hi], int(hi - lo)) if hi > lo else np.empty(0, np.uint64))
    return out


@lru_cache(maxsize=64)
def _size_classes(upto: int) -> np.ndarray:
    s = [1]
    while s[-1] <= upto:
        s.append(max(s[-1] + 1, int(s[-1] * CLASS_RATIO)))
    return np.array(s, np.int64)


def size_classes(upto: int) -> np.ndarray:
    """First sizes of the size classes, past ``upto``: 1, 2, ... growing by CLASS_RATIO."""
    return _size_classes(1 << int(upto).bit_length())


def differing(percent: int, largest: int) -> int:
    """Most elements that two sets of at most ``largest`` elements may not share."""
    # 100 I >= p (S - I) and D = S - 2 I  give  D <= S (100 - p) / (100 + p), S <= 2 * largest
    return 2 * largest * (100 - percent) // (100 + percent)


def ranges(percent: int, largest: int) -> tuple[int, int]:
    """(m, least): cut the hash space into m ranges, and sets of at most ``largest`` elements
    at the wanted similarity agree on ``least`` of them at least (they differ in m - least)."""
    h = differing(percent, largest)
    least = 3 + h // 5
    return h + least, least


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, size class of each) of a sorted set: one per range and size class the set
    may meet partners in. Similar sets share ``least`` signatures of one class."""
    n = len(s)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    bounds = size_classes(n * 100 // percent + 1)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    top = int(np.searchsorted(bounds, n * 100 // percent, side="right")) - 1
    out, mixed = [], T.mix(s)
    for k in range(own, top + 1):
        m, _ = ranges(percent, int(bounds[k + 1]) - 1)
        # range of an element: floor(e * m / 2^64), in 32-bit halves; non-decreasing along s
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        at = np.flatnonzero(np.diff(part, prepend=part[0] + np.uint64(m)))
        body = np.zeros(m, np.uint64)
        body[part[at]] = np.add.reduceat(mixed, at)
        out.append(T.mix(body + T.mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 32))))
    return np.concatenate(out), np.repeat(np.arange(own, top + 1), [len(x) for x in out])


class Forest:
    """Union-find over 0..n-1; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class _Node:
    __slots__ = ("edge", "kids", "ends", "short", "long", "label")

    def __init__(self, edge, label):
        self.edge, self.kids, self.ends = edge, {}, []
        self.short, self.long, self.label = 1 << 60, 0, label


class PrefixTree:
    """Radix tree of sets written in one global order (arrays of ascending ranks)."""

    def __init__(self, percent: int, forest: Forest):
        self.root, self.p, self.forest = _Node(np.empty(0, np.int64), None), percent, forest

    def insert(self, s: np.ndarray, who: int) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            self._note(node, n, who)
            if at == n:
                node.ends.append(who)
                return
            kid = node.kids.get(int(s[at]))
            if kid is None:
                leaf = _Node(s[at:], who)
                self._note(leaf, n, who)
                leaf.ends.append(who)
                node.kids[int(s[at])] = leaf
                return
            m = min(len(kid.edge), n - at)
            same = kid.edge[:m] == s[at: at + m]
            common = m if same.all() else int(same.argmin())
            if common < len(kid.edge):  # split the edge
                mid = _Node(kid.edge[:common], kid.label)
                mid.short, mid.long = kid.short, kid.long
                kid.edge = kid.edge[common:]
                mid.kids[int(kid.edge[0])] = kid
                node.kids[int(s[at])] = mid
                kid = mid
            node, at = kid, at + common

    def _note(self, node: _Node, n: int, who: int) -> None:
        node.short, node.long = min(node.short, n), max(node.long, n)
        if node.label is not None and self.forest.find(node.label) != self.forest.find(who):
            node.label = None  # sets of several groups lie below

    def links(self, s: np.ndarray, mask: np.ndarray, who: int, every: bool = False) -> list[int]:
        """Stored sets similar to ``s``. Unless ``every``, subtrees and sets already in the
        same group as ``who`` are skipped and each hit joins the groups at once."""
        p, q, found, find = self.p, len(s), [], self.forest.find
        todo = [(kid, 0, 0) for kid in self.root.kids.values()]
        if q == 0:
            return found
        while todo:
            node, depth, overlap = todo.pop()
            if not every and node.label is not None and find(node.label) == find(who):
                continue
            if 100 * min(node.long, q) < p * max(node.short, q):
                if node.long < q or node.short > q:
                    continue
            overlap += int(np.count_nonzero(mask[node.edge]))
            depth += len(node.edge)
            # elements of s up to this point of the order that the path lacks cannot come later
            passed = int(np.searchsorted(s, node.edge[-1], side="right"))
            left = q - passed
            best = overlap + min(left, node.long - depth)
            if 100 * best < p * (q + depth - overlap):  # union is at least |s| plus the path's misses
                continue
            for e in node.ends:  # depth is the whole length of these
                if 100 * overlap >= p * (q + depth - overlap):
                    if every:
                        found.append(e)
                    elif find(e) != find(who):
                        self.forest.union(e, who)
                        found.append(e)
            todo.extend((kid, depth, overlap) for kid in node.kids.values())
        return found


def tree_links(sets: list[np.ndarray], percent: int, group: list | None = None, every: bool = False) -> tuple[list[tuple[int, int]], Forest]:
    """Links (i, j) among sets of one area and the forest that they form; enough links to
    connect what is connected, or all if ``every``.

    ``group``: equal values are connected already. The order puts the elements that most
    sets share first (ties by hash), so that near copies share long paths.
    """
    forest, out = Forest(len(sets)), []
    if group is not None:
        seen: dict = {}
        for i, g in enumerate(group):
            forest.union(i, seen.setdefault(g, i))
    if len(sets) < 2:
        return out, forest
    universe, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(universe), np.int64)
    rank[np.lexsort((universe, -df))] = np.arange(len(universe))
    coded = np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])
    mask = np.zeros(len(universe), bool)
    tree = PrefixTree(percent, forest)
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        s = np.sort(coded[i])
        if len(s):
            mask[s] = True
            out += [(j, i) for j in tree.links(s, mask, i, every)]
            mask[s] = False
            tree.insert(s, i)
    return out, forest


# --- Spark side -------------------------------------------------------------------------


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, with_set: bool = True) -> DataFrame:
    """(id, n_shingles, set_hi, set_lo[, grams]): one row per input row. ``set_hi`` and ``set_lo``
    are 128 bits that name the set; ``grams`` is the set itself (little-endian 64-bit hashes,
    sorted). Null or empty text: empty set. Null ids stay null.
    """
    names = ["id", "n_shingles", "set_hi", "set_lo"] + ["grams"] * with_set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            sets = _doc_sets(*T.flat(b.column(1)), n)
            size = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate(sets)
            total = [np.concatenate([[np.uint64(0)], np.cumsum(T.mix(every ^ np.uint64(x)), dtype=np.uint64)]) for x in (0, 0xA5A5A5A5A5A5A5A5)]
            end = np.cumsum(size)
            hi, lo = (t[end] - t[end - size] for t in total)
            cols = [b.column(0).cast(pa.int64()), pa.array(size), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())] * with_set, names=names)

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, n_shingles long, set_hi long, set_lo long" + ", grams binary" * with_set))


def _met(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """(key, a, rest): one row per key of a batch, with its first node in ``a`` and any others
    (rare) in the list ``rest``, so that a key of a third of all rows is one row per batch."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    more = np.ones(len(keys), bool)
    more[first] = False
    count = np.diff(np.append(first, len(keys))) - 1
    rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(nodes[more]), mask=pa.array(count == 0))
    return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(nodes[first]), rest], names=["key", "a", "rest"])


def _shared(rows: DataFrame) -> DataFrame:
    """(key, class, df) of the rows of ``_met`` whose key more than one class holds; ``df`` of them do."""
    key = Window.partitionBy("key")
    return (rows.withColumn("df", F.sum(F.lit(1) + F.coalesce(F.size("rest"), F.lit(0))).over(key)).where("df > 1")
            .select("key", F.explode(F.when(F.col("rest").isNull(), F.array("a")).otherwise(F.concat(F.array("a"), "rest"))).alias("class"), "df"))


#: Bits of a signature that hold its size class.
_CLASS_BITS = 8


def _chains(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): b is the smallest class that a meets in one of a's rarest signatures, for the
    classes of ``texts`` (class, text) that can have a partner at all.

    Similar sets share ``least`` signatures of a size class (see ``ranges``). A class with
    fewer that any others hold has no partner there. In the global order, rarest signature
    first, ties by hash, two similar sets share one that is not among the last ``least - 1``
    of either, so those (what common passages give) need not chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            sig = [signatures(s, percent) for s in _doc_sets(*T.flat(b.column(1)), n)]
            name = np.concatenate([x for x, _ in sig]) << np.uint64(_CLASS_BITS) | np.concatenate([k for _, k in sig]).astype(np.uint64)
            yield _met(name.view(np.int64), np.repeat(T.ids(b.column(0)), [len(x) for x, _ in sig]))

    shared = _shared(texts.mapInArrow(run, "key long, a long, rest array<long>")).withColumn("k", F.col("key").bitwiseAND(F.lit((1 << _CLASS_BITS) - 1)))
    bounds = size_classes(1 << 31)  # a few dozen size classes
    least = F.element_at(F.array(*[F.lit(ranges(percent, int(b) - 1)[1]) for b in bounds[1:]]), (F.col("k") + 1).cast("int"))
    own = Window.partitionBy("class", "k")
    kept = cut(shared.withColumn("held", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("df", "key")))
               .where(F.col("at") <= F.col("held") - least + 1).select("key", F.col("class").alias("a")), "ngram-chains")
    low = _own_key(kept.groupBy("key").agg(F.min("a").alias("b")), "key")
    return kept.join(low, "key").where("a != b").select("a", "b").distinct()


#: Counters of one row of the element sketch: twice the elements counted, within these.
SLOTS = (1 << 12, 1 << 20)
#: Bytes of sets that one task counts.
COUNT_BYTES = 64 << 20
_SALTS = (np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B))


def _slots(e: np.ndarray, slots: int) -> list[np.ndarray]:
    return [(T.mix(e ^ salt) & np.uint64(slots - 1)).astype(np.int64) for salt in _SALTS]


def _element_counts(sets: DataFrame) -> np.ndarray:
    """Two rows of counters; the smaller of an element's two is at least the number of rows of
    ``sets`` that hold it. Bounded by SLOTS whatever the table: more elements only make the
    counters coarser."""
    elements = int(sets.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) // 8
    slots = min(max(1 << (2 * elements).bit_length(), SLOTS[0]), SLOTS[1])
    block = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, slots), np.int64)
        for b in T.slices(batches, "grams"):
            buf, _ = T.flat(b.column(0))
            for row, at in zip(total, _slots(np.frombuffer(buf.tobytes(), "<u8"), slots)):
                np.add.at(row, at, 1)
        parts = total.reshape(-1, block)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["at", "n"])

    tasks = max(8, -(-8 * elements // COUNT_BYTES))
    out = np.zeros((2 * slots // block, block), np.int64)
    for r in sets.select("grams").coalesce(tasks).mapInArrow(count, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary").collect():
        out[r["at"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(2, slots)


def set_prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The elements of a sorted set that a partner must share one of, in the global order by
    (count, hash): the first n - ceil(percent n / 100) + 1, without those that no other set holds."""
    n = len(s)
    held = np.minimum(*(row[at] for row, at in zip(counts, _slots(s, counts.shape[1]))))
    first = np.lexsort((s, held))[: n + (-percent * n // 100) + 1]
    return s[first[held[first] > 1]]


def _element_chains(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): b is the smallest class that holds one of a's prefix elements in its own prefix,
    for ``sets`` (class, grams) of areas that are still large.

    The global order: elements by their count in a sketch of all these sets, rarest first,
    ties by hash. Any order that all sets share loses no link (see ``set_prefix``); this one
    puts what a common passage brings last, so sets that merely share a passage come apart.
    Only prefixes leave a task, one row an element and batch."""
    counts = sets.sparkSession.sparkContext.broadcast(_element_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "grams"):
            buf, off = T.flat(b.column(1))
            every = np.frombuffer(buf.tobytes(), "<u8")
            prefix = [set_prefix(every[lo: hi], counts.value, percent) for lo, hi in zip(off[:-1] // 8, off[1:] // 8)]
            yield _met(np.concatenate(prefix).astype(np.uint64).view(np.int64), np.repeat(T.ids(b.column(0)), [len(x) for x in prefix]))

    rows = cut(sets.select("class", "grams").mapInArrow(run, "key long, a long, rest array<long>"), "ngram-elements")
    held = F.lit(1) + F.coalesce(F.size("rest"), F.lit(0))
    low = _own_key(rows.groupBy("key").agg(F.min("a").alias("b"), F.sum(held).alias("held")).where("held > 1").select("key", "b"), "key")
    every = F.when(F.col("rest").isNull(), F.array("a")).otherwise(F.concat(F.array("a"), "rest"))
    return rows.join(low, "key").select(F.explode(every).alias("a"), "b").where("a != b").distinct()


@lru_cache(maxsize=4096)
def _classes_of(n: int, percent: int) -> list[tuple[int, tuple[int, int]]]:
    """(size class, (m, least)) of the classes that a set of n elements has signatures in."""
    bounds = size_classes(n * 100 // percent + 1)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    top = int(np.searchsorted(bounds, n * 100 // percent, side="right")) - 1
    return [(k, ranges(percent, int(bounds[k + 1]) - 1)) for k in range(own, top + 1)]


def _join_areas(rows: DataFrame, percent: int) -> DataFrame:
    """(class, grp, head) of every row (area, class, grp, grams): ``head`` is the smallest
    ``grp`` that is connected to the row's inside its area.

    ``grp`` marks classes that are connected already. One area is in one task; areas are
    streamed one after the other, so memory holds one area (at most 2 * AREA_SETS sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area, who, grp, sets = None, [], [], []

        def done():
            _, forest = tree_links(sets, percent, grp)
            low: dict[int, int] = {}
            for i, g in enumerate(grp):
                r = forest.find(i)
                low[r] = min(g, low.get(r, g))
            heads = [low[forest.find(i)] for i in range(len(sets))]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (who, grp, heads)], names=["class", "grp", "head"])

        for b in batches:
            for x, c, g, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                if x != area:
                    if sets:
                        yield done()
                    area, who, grp, sets = x, [], [], []
                who.append(c)
                grp.append(g)
                sets.append(np.frombuffer(s, "<u8").astype(np.uint64))
        if sets:
            yield done()

    return (rows.select("area", "class", "grp", "grams").repartition("area").sortWithinPartitions("area", "class")
            .mapInArrow(run, "class long, grp long, head long"))


def jaccard_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, class_id, component_id): one row per row of ``docs``.

    Two documents are linked when 100 * |A n B| >= percent * |A u B| over their sets of
    distinct lower-cased word n-grams. ``class_id`` is the smallest id with the same set,
    ``component_id`` the smallest id reachable by links.

    Defined cases: null, empty or blank text has an empty set, links with nothing and is
    its own class and component; fewer than n words form one element; repeated rows are
    repeated in the result and share a class; rows with a null id keep a null component
    unless their set occurs under an id; other columns are not read; an empty table gives
    an empty result.
    """
    prepare_session(spark)
    base = cut(shingle_sets(docs, id_col, text_col, n, with_set=False), "ngram-sizes")
    classes = cut(base.where("n_shingles > 0 and id is not null").groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("id").alias("class")), "ngram-classes")
    texts = docs.select(F.col(id_col).cast("long").alias("class"), F.col(text_col).alias("text"))
    ids = classes.select("class").distinct()
    # one document per class saves work; without the list in memory the copies go along and leave below
    first = texts.join(F.broadcast(ids), "class", "left_semi") if ids.count() * 16 <= BROADCAST_BYTES else texts.where("class is not null")
    areas = components(_chains(first, n, percent)).select(F.col("node").alias("class"), F.col("component").alias("area")).join(ids, "class", "left_semi")
    areas = cut(areas.join(areas.groupBy("area").agg(F.count("*").alias("members")).where("members > 1"), "area"), "ngram-areas")
    sets = cut(shingle_sets(texts.join(small(areas.select("class")), "class", "left_semi"), "class", "text", n).select(F.col("id").alias("class"), "grams"), "ngram-sets")
    comps = _area_heads(areas, lambda some: sets.join(small(some, 32), "class"), percent)
    known = (classes.select("set_hi", "set_lo", "n_shingles", "class").join(comps, "class", "left")
             .select("set_hi", "set_lo", "n_shingles", F.col("class").alias("class_id"), F.coalesce("component", "class").alias("component_id")))
    return (base.select("id", "n_shingles", "set_hi", "set_lo").join(known, ["set_hi", "set_lo", "n_shingles"], "left")
            .select("id", "n_shingles", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id")))


def _area_heads(areas: DataFrame, sets_of, percent: int, most: int | None = None) -> DataFrame:
    """(class, component) for the classes of every area (class, area, members)."""
    most = most or AREA_SETS

    def block(salt: int, members) -> F.Column:
        return F.pmod(F.xxhash64("class", F.lit(salt)), F.ceil(members / F.lit(most)).cast("long"))

    large = areas.where(F.col("members") > most)
    if not large.isEmpty():  # chain these again by elements; what has no partner drops out
        again = components(_element_chains(sets_of(large.select("class")), percent)).select(F.col("node").alias("class"), F.col("component").alias("area"))
        again = again.join(again.groupBy("area").agg(F.count("*").alias("members")), "area").select(*areas.columns)
        areas = cut(areas.where(F.col("members") <= most).unionByName(again), "ngram-areas")
    rows = areas.select("class", F.col("class").alias("grp"), F.xxhash64("area", block(0, F.col("members"))).alias("area"))
    heads = cut(_join_areas(sets_of(rows), percent).select("class", F.col("head").alias("component")).distinct(), "ngram-heads")
    big = areas.where(F.col("members") > most)
    if big.isEmpty():
        return heads
    now = cut(big.select("class", "area").join(heads, "class"), "ngram-big")

    def renamed(now: DataFrame, names: DataFrame) -> DataFrame:
        """``now`` with the new component of each old one, where (grp, head) has it."""
        names = names.where("grp != head").select(F.col("grp").alias("component"), "head").distinct()
        return cut(now.join(names, "component", "left").select("class", "area", F.coalesce("head", "component").alias("component")), "ngram-big")

    # one leader per group (its smallest class); in other blocks again while they are many
    before = None
    for salt in range(1, 8):
        lead = now.where("class = component").drop("component")
        lead = cut(lead.join(lead.groupBy("area").agg(F.count("*").alias("members")).where("members > 1"), "area"), "ngram-lead")
        most_left = lead.agg(F.max("members")).first()[0]
        if most_left is None or before is not None and most_left > 0.8 * before:
            break  # none left, or blocks no longer find links: the complete step follows
        before = most_left
        rows = lead.select("class", F.col("class").alias("grp"), F.xxhash64("area", F.lit(salt), block(salt, F.col("members"))).alias("area"))
        now = renamed(now, _join_areas(sets_of(rows), percent))
        if most_left <= most:
            break
    now = _rest(now, sets_of, percent, most, renamed)
    return heads.join(big.select("class"), "class", "left_anti").unionByName(now.select("class", "component"))


def _rest(now: DataFrame, sets_of, percent: int, most: int, renamed) -> DataFrame:
    """The last, complete step of a large area: all that is outside its largest group
    against every block of the area."""
    count = now.groupBy("area", "component").agg(F.count("*").alias("k"))
    largest = count.groupBy("area").agg(F.max_by("component", F.struct("k", -F.col("component"))).alias("largest"), F.sum("k").alias("all"), F.max("k").alias("top"))
    open_ = cut(now.withColumnRenamed("component", "grp").join(largest.where("all > top"), "area"), "ngram-open")
    if open_.isEmpty():
        return now
    n_all = F.ceil(F.col("all") / F.lit(most)).cast("long")
    n_few = F.ceil((F.col("all") - F.col("top")) / F.lit(most)).cast("long")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    each = open_.withColumn("i", F.pmod(F.xxhash64("class", F.lit(11)), n_all)).withColumn("j", upto(n_few))
    few = open_.where("grp != largest").withColumn("j", F.pmod(F.xxhash64("class", F.lit(12)), n_few)).withColumn("i", upto(n_all))
    rows = each.unionByName(few).select("class", "grp", F.xxhash64("area", F.lit(-1), "i", "j").alias("area")).distinct()
    links = _join_areas(sets_of(rows), percent).where("grp != head").select("grp", "head").distinct()
    return renamed(now, components(links, "grp", "head").select(F.col("node").alias("grp"), F.col("component").alias("head")))


def q_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: 4-word shingles, similarity 85 in 100."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_classes(spark, docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


SQL_NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.low < e.b),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(grams)) AS class_id FROM s WHERE len(grams) > 0)
SELECT s.doc_id, len(s.grams) AS n_shingles, c.component_id, coalesce(k.class_id, s.doc_id) AS class_id
FROM s JOIN (SELECT node, min(low) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
LEFT JOIN classes k ON k.doc_id = s.doc_id
"""
