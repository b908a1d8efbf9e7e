"""N-gram Jaccard join: which documents share at least a given share of their word shingles.

A document's set is its distinct shingles of ``n`` words (all its words as one, if fewer).
Two documents link when their Jaccard coefficient reaches ``percent`` hundredths, decided in
whole numbers. The result is complete: no linked pair of different texts is left out.

1. Equal sets are one class, known by a 128-bit digest; copies are never paired.
2. Hash groups. Shingle hashes are dealt into groups by their leading bits. Linked sets differ
   in a bounded number of shingles, so with more groups than that some group has equal content
   in both. The digest of a group's content is a key, empty groups have none: a linked pair
   lacks a common key only if *both* sets fill too few groups, and a set that does is keyed
   again by another dealing, and so on (after the last, by its single shingles). How many groups
   there are follows from the size class of a set; sets near the next class are keyed for it too.
3. Count vectors. A set is a point whose coordinates count its shingles by hash. The sum of the
   lesser coordinates bounds the overlap of two sets, and no pair is verified that the bound
   excludes. First every class is compared with the least one of each of its keys: bounded,
   verified, joined. Keys whose classes are then in one component are done, however many they
   are. For every other key the points of its classes make a packed R-tree: pairs of nodes are
   compared by the lesser of their upper bounds, from the root down, and of the pairs of
   points that can link a spanning forest is kept. What those connect are the blocks.
4. The sets of a block are verified along an R-tree of theirs, unless they are connected already:
   components need no second proof. Keys and blocks too large for a task are dealt into chunks,
   and each pair of chunks is a task of its own.

Defined cases: a null text, or one without words, has an empty set and links with nothing.
A row with a null id takes part through a row with an id and an equal set; without one it
stands alone and its component is null. Rows that share an id and differ in text are different
documents. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waneline.llm import text as T

#: Coordinates of count vectors, at least; and numbers that the vectors of one block may take.
DIMS = 128
MOST_CELLS = 1 << 24
LEAF = 16
#: Members of a key, and sets of a block, that one task takes; of more, chunks of about so many are made.
KEY_ROWS = 4096
BLOCK_ROWS = 512
#: Copies of one text above which a class is looked up apart from the others.
HOT_COPIES = 1000
#: Sets that one task compares with a common centre.
STAR_ROWS = 512
#: Shingles whose texts a task of verification takes, in several keys, stars or blocks.
TASK_SHINGLES = 1 << 20
FLUSH = 1 << 20
#: A task that has a key for more classes than this sends the key on for one of them only, with a star of the others.
LOCAL = 64
#: Bytes of keys in one bucket of theirs.
BUCKET_BYTES = 1 << 25
#: Dealings into groups before single shingles are the keys.
DEALINGS = 8


@dataclass(frozen=True)
class Rule:
    """Shingles of n words; linked if 100 * intersection >= percent * union."""

    n: int = 4
    percent: int = 85

    def overlap(self, a, b):
        """Least intersection of linked sets of a and b shingles."""
        return -(-(self.percent * (a + b)) // (100 + self.percent))

    def differ(self, most: int) -> int:
        """Most shingles that only one of two linked sets of up to ``most`` shingles has."""
        return (100 - self.percent) * 2 * most // (100 + self.percent)

    def __post_init__(self):
        if not 70 <= self.percent <= 100 or self.n < 1:
            raise ValueError("shingles have a word or more, and percent is 70 to 100")

    def classes(self, most: int) -> list[tuple[int, int, int]]:
        """Size classes (from, to, groups): linked sets are in one class or in neighbours.

        There are so many groups that even the smallest set keyed in the class fills more of
        them than linked sets can differ in, unless it deviates by two standard errors.
        """
        out, lo = [], 1
        while lo <= most:
            hi = max(lo + 1, math.ceil(lo * 102 / self.percent))
            differ = self.differ(hi - 1)
            least = max(1, math.ceil(lo * self.percent / 100))
            groups = differ + 1 if differ else 1
            while differ and groups < 4 * least:
                load = least / groups
                empty = groups * math.exp(-load)
                spread = math.sqrt(empty * max(0.0, 1 - (1 + load) * math.exp(-load)))
                if groups - empty - 2 * spread >= differ + 1:
                    break
                groups += max(1, groups // 128)
            out.append((lo, hi, groups))
            lo = hi
        return out


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = T.buffer(texts)
    w = T.words(data, off, lower=True)
    runs = T.mix(T.windows(w.hash, n) ^ np.uint64(n)) if len(w.hash) >= n else np.empty(0, np.uint64)
    out = []
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(runs[a : z - n + 1]))
        elif z > a:
            out.append(T.mix(T.windows(w.hash[a:z], z - a) ^ np.uint64(z - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed numbers."""
    a = np.add.reduce(T.mix(s ^ np.uint64(0x1B873593CC9E2D51)))
    b = np.add.reduce(T.mix(s ^ np.uint64(0xE6546B64E6546B65)))
    x = T.mix(np.array([a ^ np.uint64(len(s)), b + np.uint64(len(s))], np.uint64)).view(np.int64)
    return int(x[0]), int(x[1])


@functools.cache
def _seed(*parts: int) -> np.uint64:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = T.mix(x + np.uint64((p * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1)))
    return x[0]


def keys(s: np.ndarray, rule: Rule, table: list[tuple[int, int, int]]) -> np.ndarray:
    """Keys of a set: one for each group with content, in its size class and, near the end of that, in the next.

    Dealings go on until one fills more groups than linked sets of the class can differ in.
    Of two linked sets take the first dealing that does so for either: both are keyed by it,
    more groups are equal than that set leaves empty, so some equal group has content.
    """
    n = len(s)
    at = next(i for i, (lo, hi, _) in enumerate(table) if lo <= n < hi)
    out = []
    for i in (at, at + 1):
        lo, hi, groups = table[i]
        differ = rule.differ(hi - 1)
        if not differ or (i > at and rule.overlap(n, lo) > n):
            continue  # linked sets of this size are equal, or no set of the next class is near enough
        for deal in range(DEALINGS):
            x = np.sort(T.mix(s ^ _seed(deal))) if deal else s
            group = ((x >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            out.append(T.mix(np.add.reduceat(T.mix(x ^ _seed(i, deal, 1)), begin) + group[begin]))
            if len(begin) > differ:
                break
        else:
            out.append(T.mix(s ^ _seed(i, 2)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


# --- classes and blocks ------------------------------------------------------------------


def classed(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, class digest (s1, s2) and count vector of every document; null digests for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole):
                sets = shingle_sets(b.column("text"), rule.n)
                d = [_digest(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array([_packed_vector(s) for s in sets], pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "vector"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, vector binary")


def dims_of(n: int) -> int:
    """Coordinates for a set of n shingles: so many that unlike sets of its size seldom look alike, about 8 a coordinate at most."""
    return max(DIMS, 1 << max(0, (n - 1) // 8).bit_length())


def _packed_vector(s: np.ndarray) -> bytes:
    """The counts as bytes where they fit, else as four bytes each; the width comes first."""
    c = count_vector(s, dims_of(len(s)))
    return b"\1" + c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b"\4" + c.astype("<u4").tobytes()


def _dims(blobs: list[bytes]) -> np.ndarray:
    return np.array([(len(b) - 1) // b[0] for b in blobs], np.int64)


def _points(blobs: list[bytes], dims: int) -> np.ndarray:
    """The vectors with coordinates summed to so many: groups are leading bits, so neighbours go together."""
    out = np.empty((len(blobs), dims), np.int32)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(blobs):
        kinds.setdefault((b[0], len(b)), []).append(i)
    for (width, _), at in kinds.items():
        all_ = np.frombuffer(b"".join(blobs[i][1:] for i in at), np.uint8 if width == 1 else "<u4")
        out[at] = all_.reshape(len(at), dims, -1).sum(2)
    return out


def can_link(edges: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The edges (u, v) without those whose summed coordinate minima stay below the needed overlap."""

    @F.pandas_udf("boolean")
    def bounded(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.tolist(), b.tolist()
        dims = np.minimum(_dims(a), _dims(b))
        out = np.empty(len(a), bool)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x, y = _points([a[i] for i in at], d), _points([b[i] for i in at], d)
            out[at] = np.minimum(x, y).sum(1) >= rule.overlap(x.sum(1), y.sum(1))
        return pd.Series(out)

    side = lambda name: classes.select(F.col("s1").alias(name), F.col("vector").alias(f"v{name}"))
    return edges.join(side("u"), "u").join(side("v"), "v").filter(bounded("vu", "vv")).select("u", "v")


def shared_keys(docs: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """Rows (k, u, v) for each key k of two classes or more: every class v of the key, beside a class u of the key.

    u is the least class of the key, or one of those of a task's flush for keys that it has for
    more than LOCAL classes; the ones of the flushes stand beside the least of all. So a
    bucket holds a bounded number of entries of a key for each flush, and the rows of a key
    connect its classes.
    """

    def of(k: np.ndarray) -> np.ndarray:
        """Bucket of each key: a range of keys, so that sorted keys come by buckets."""
        return (((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)

    def packed(bucket: np.ndarray, *columns: np.ndarray) -> list[list]:
        """The sorted buckets, and the bytes of each column in each of them."""
        if not len(bucket):
            return [[] for _ in range(len(columns) + 1)]
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        cut = list(zip(begin, np.append(begin[1:], len(bucket)), strict=True))
        return [bucket[begin].tolist(), *([c[i:j].tobytes() for i, j in cut] for c in columns)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k: list[np.ndarray] = []
        held_s: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0
        table = rule.classes(1 << 16)

        def flush() -> Iterator[pa.RecordBatch]:
            k, s = np.concatenate(held_k), np.concatenate(held_s)
            order = np.argsort(k)
            k, s = k[order], s[order]
            begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            count = np.diff(np.append(begin, len(k)))
            many = np.repeat(count > LOCAL, count)
            send = ~many
            send[begin] = True
            b, keys_, names = packed(of(k[send]), k[send], s[send])
            star_k, star_v, star_u = k[many], s[many], np.repeat(s[begin], count)[many]
            spread = of(T.mix(star_v.view(np.uint64)))
            by = np.argsort(spread, kind="stable")
            at, star_k, star_v, star_u = packed(spread[by], star_k[by], star_v[by], star_u[by])
            yield pa.RecordBatch.from_arrays([pa.array(b + at, pa.int32()), pa.array(keys_ + star_k, pa.binary()), pa.array(names + star_v, pa.binary()), pa.array([None] * len(b) + star_u, pa.binary())], ["b", "k", "s", "u"])

        for whole in batches:
            for b in T.slices(whole):
                for s in shingle_sets(b.column("text"), rule.n):
                    if not len(s):
                        continue
                    d = _digest(s)
                    if d in seen:
                        continue
                    seen.add(d)
                    if len(s) >= table[-1][0]:
                        table = rule.classes(2 * len(s))
                    k = keys(s, rule, table)
                    held_k.append(k)
                    held_s.append(np.full(len(k), d[0], np.int64))
                    size += len(k)
                if size > FLUSH:
                    yield from flush()
                    held_k, held_s, size = [], [], 0
                if len(seen) > 250_000:
                    seen.clear()
        if size:
            yield from flush()

    def meet(t: pa.Table) -> pa.Table:
        read = lambda name, kind, rows: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        stars, plain = t.filter(pc.is_valid(t.column("u"))), t.filter(pc.is_null(t.column("u")))
        k, s = read("k", np.uint64, plain), read("s", np.int64, plain)
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[fresh], s[fresh]
        begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
        count = np.diff(np.append(begin, len(k)))
        common = np.repeat(count > 1, count)
        out = [(k[common], np.repeat(s[begin], count)[common], s[common]), (read("k", np.uint64, stars), read("u", np.int64, stars), read("s", np.int64, stars))]
        return pa.table({name: pa.array(np.concatenate(x).view(np.int64)) for name, x in zip(("k", "u", "v"), zip(*out, strict=True), strict=True)})

    return docs.select("text").mapInArrow(gather, "b int, k binary, s binary, u binary").groupBy("b").applyInArrow(meet, "k long, u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the least node of its component.

    Large-star and small-star rounds: each keeps components, and all edges end at the roots.
    Every round is written to the shared folder; the driver sees two numbers of it.
    """
    edges = T.written(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = None
    while True:
        spent = edges
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("u"), F.col("b").alias("v")).distinct()
        # small star: each node's lesser neighbours, and itself, are hung below the least
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        edges = T.written(small)
        T.discard(spent)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select("u", "u").distinct())


# --- the tree ----------------------------------------------------------------------------


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def count_vector(s: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Number of shingles in each group; groups are the leading bits of the hash."""
    shift = np.uint64(64 - dims.bit_length() + 1)
    return np.bincount((s >> shift).astype(np.int64), minlength=dims).astype(np.int32)


class Tree:
    """A packed R-tree over count vectors: levels of nodes with upper bounds by coordinate and least sizes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.empty(0, np.int64)
        parts = [np.arange(len(points))]
        while parts and max(map(len, parts)) > leaf:  # halve along the coordinate that spreads most
            split = []
            for p in parts:
                if len(p) <= leaf:
                    split.append(p)
                    continue
                x = points[p]
                axis = int((x.max(0) - x.min(0)).argmax())
                by = p[np.argsort(x[:, axis], kind="stable")]
                split += [by[: len(by) // 2], by[len(by) // 2 :]]
            parts = split
        self.leaves = parts
        upper = np.stack([points[p].max(0) for p in parts])
        least = np.array([points[p].sum(1).min() for p in parts])
        self.levels = [(upper, least)]
        while len(self.levels[-1][0]) > 1:
            upper, least = self.levels[-1]
            begin = np.arange(0, len(upper), 8)
            self.levels.append((np.maximum.reduceat(upper, begin), np.minimum.reduceat(least, begin)))


def _walk(left: Tree, right: Tree | None, rule: Rule) -> list[tuple[int, int]]:
    """Pairs of leaves of two trees (or of one) whose sets may reach the needed overlap: from the roots down, near ones first."""
    same, right = right is None, right or left
    level_a, level_b = len(left.levels) - 1, len(right.levels) - 1
    pairs = np.array([[0, 0]])
    while True:
        ua, la = left.levels[level_a]
        ub, lb = right.levels[level_b]
        kept = []
        for at in range(0, len(pairs), 65536):
            p = pairs[at : at + 65536]
            bound = np.minimum(ua[p[:, 0]], ub[p[:, 1]]).sum(1)
            kept.append(p[bound >= rule.overlap(la[p[:, 0]], lb[p[:, 1]])])
        pairs = np.concatenate(kept)
        if (level_a == 0 and level_b == 0) or not len(pairs):
            break
        children = []
        for side, level, tree in ((0, level_a, left), (1, level_b, right)):
            if level:
                below = len(tree.levels[level - 1][0])
                first = pairs[:, side] * 8
                children.append((first, np.minimum(8, below - first)))
            else:
                children.append((pairs[:, side], np.ones(len(pairs), np.int64)))
        (fa, na), (fb, nb) = children
        total = na * nb
        owner = np.repeat(np.arange(len(pairs)), total)
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        pairs = np.stack([fa[owner] + k // nb[owner], fb[owner] + k % nb[owner]], axis=1)
        if same:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        level_a, level_b = max(0, level_a - 1), max(0, level_b - 1)
    near = np.argsort(np.abs(pairs[:, 0] - pairs[:, 1]), kind="stable")  # close leaves connect most
    return [(int(x), int(y)) for x, y in pairs[near]]


def forest(points: np.ndarray, rule: Rule, label: np.ndarray, split: int | None = None, overlaps: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of points with different labels that the bound admits.

    With ``overlaps`` (of one place with several) only pairs that reach the needed overlap count,
    and points of one label are connected beforehand. With ``split`` only pairs across that
    place are looked at: those within each side are another task's.
    """
    points = points.astype(np.int32)
    size = points.sum(1)
    union = _Union(len(points))
    if overlaps:
        first: dict[int, int] = {}
        for i, x in enumerate(label.tolist()):
            union.join(first.setdefault(x, i), i)
    left = Tree(points[:split])
    right, shift = (None, 0) if split is None else (Tree(points[split:]), split)
    links: list[tuple[int, int]] = []
    for x, y in _walk(left, right, rule):
        a, b = left.leaves[x], (right or left).leaves[y] + shift
        if len({union.root(i) for i in (*a, *b)}) == 1:
            continue
        need = rule.overlap(size[a][:, None], size[b][None])
        ok = (label[a][:, None] != label[b][None]) & (np.minimum(points[a][:, None], points[b][None]).sum(2) >= need)
        if right is None and x == y:
            ok &= a[:, None] < b[None]
        for p in np.flatnonzero(ok.any(1)).tolist():
            i, cols = int(a[p]), [q for q in np.flatnonzero(ok[p]).tolist() if union.root(int(b[q])) != union.root(int(a[p]))]
            if not cols:
                continue
            enough = overlaps(i, b[cols]) >= need[p, cols] if overlaps else np.ones(len(cols), bool)
            for q in np.flatnonzero(enough).tolist():
                j = int(b[cols[q]])
                if union.root(i) != union.root(j):
                    union.join(i, j)
                    links.append((i, j))
    return links


def overlap_of(s: np.ndarray, t: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum()) if len(t) else 0


def link_within(sets: list[np.ndarray], rule: Rule, label: np.ndarray | None = None, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, or of those across a place; sets of one label count as linked."""
    label = np.arange(len(sets)) if label is None else label
    size = np.array([len(s) for s in sets])
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.append(0, np.cumsum(size))
    mark = np.zeros(len(known), bool)

    def overlaps(i: int, others: np.ndarray) -> np.ndarray:
        mark[place[at[i] : at[i + 1]]] = True
        n = size[others]
        begin = np.cumsum(n) - n
        hit = mark[place[np.repeat(at[others] - begin, n) + np.arange(n.sum())]]
        mark[place[at[i] : at[i + 1]]] = False
        return np.add.reduceat(hit, begin, dtype=np.int64)

    dims = dims_of(int(size.max()))
    while dims > DIMS and dims * len(sets) > MOST_CELLS:
        dims //= 2
    return forest(np.stack([count_vector(s, dims) for s in sets]), rule, label, split, overlaps)


# --- the join ----------------------------------------------------------------------------


def dealt(rows: DataFrame, group: str, most: int, of: str = "v") -> DataFrame:
    """The rows with ``part`` and ``side``: a group of up to ``most`` is one part, in a larger one each pair of its chunks is a part of sides 0 and 1."""
    large = T.written(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(group, F.ceil(F.col("_n") / most).cast("int").alias("_chunks")))
    rows = rows.join(large, group, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))  # a written table has a known size: broadcast if small, else shuffled
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(of), F.col("_chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda k: F.struct(F.least(k, F.col("_chunk")).alias("i"), F.greatest(k, F.col("_chunk")).alias("j"), (k < F.col("_chunk")).cast("int").alias("side")))
    rows = rows.withColumn("_p", F.explode(pairs))
    return rows.withColumn("part", F.xxhash64(group, "_p.i", "_p.j")).withColumn("side", F.col("_p.side")).drop("_p", "_chunk", "_chunks")


def _parts(t: pa.Table, *order: str) -> Iterator[pa.Table]:
    """The rows of each part, in order of side and then the given columns."""
    t = t.sort_by([(c, "ascending") for c in ("part", "side", *order)])
    part = t.column("part").to_numpy()
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for i, j in zip(begin, [*begin[1:], len(part)], strict=True):
        yield t.slice(i, j - i)


def _split(t: pa.Table) -> int | None:
    """Where side 1 begins, if it has rows."""
    n = int((t.column("side").to_numpy() == 0).sum())
    return None if n == t.num_rows else n


def key_blocks(members: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Edges (u, v) that connect whatever classes of different labels may link, from members (k, v, label) of keys."""

    def run(t: pa.Table) -> pa.Table:
        found = []
        for p in _parts(t, "v"):
            split = _split(p)
            if split == 0:  # the other chunk is empty
                continue
            v, label, vector = p.column("v").to_numpy(), p.column("label").to_numpy(), p.column("vector").to_pylist()
            found += [(v[i], v[j]) for i, j in forest(_points(vector, int(_dims(vector).min())), rule, label, split)]
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    rows = dealt(members, "k", KEY_ROWS).join(classes.select(F.col("s1").alias("v"), "vector"), "v")
    buckets = max(T.width(members.sparkSession), math.ceil(members.count() / KEY_ROWS))
    return rows.select(F.pmod("part", F.lit(buckets)).alias("b"), "part", "side", "v", "label", "vector").groupBy("b").applyInArrow(run, "u long, v long")


def verified(docs: DataFrame, rows: DataFrame, classes: DataFrame, rule: Rule, stars: bool) -> DataFrame:
    """Links (u, v) among the texts of the rows (part, side, v, label): in a star of the one of side 0 with those of side 1, else of all labels in a part."""
    total = rows.join(classes.select(F.col("s1").alias("v"), "n"), "v").agg(F.sum("n")).first()[0] or 0
    buckets = max(T.width(docs.sparkSession), math.ceil(total / TASK_SHINGLES))

    def run(t: pa.Table) -> pa.Table:
        found = []
        for p in _parts(t, "v"):
            side, name, label, sets = [], [], [], []
            for b in p.to_batches():
                for s in T.slices(b):
                    for x, d, v, m in zip(shingle_sets(s.column("text"), rule.n), s.column("side").to_pylist(), s.column("v").to_pylist(), s.column("label").to_pylist(), strict=True):
                        if len(x) and _digest(x)[0] == v and (not name or (name[-1], side[-1]) != (v, d)):  # not another text under the same id, nor a copy
                            side.append(d)
                            name.append(v)
                            label.append(m)
                            sets.append(x)
            first = side.count(0)
            if not first or len(sets) < 2:
                continue
            if stars:
                links = [(0, j) for j in range(1, len(sets)) if overlap_of(sets[0], sets[j]) >= rule.overlap(len(sets[0]), len(sets[j]))]
            else:
                links = link_within(sets, rule, np.array(label), None if first == len(sets) else first)
            found += [(name[i], name[j]) for i, j in links]
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    named = rows.join(classes.select(F.col("s1").alias("v"), F.col("least").alias("doc_id")), "v").select(F.pmod("part", F.lit(buckets)).alias("b"), "part", "side", "v", "label", "doc_id")
    texts = docs.filter("text is not null").select("doc_id", "text").join(named.hint("shuffle_hash"), "doc_id")
    return texts.select("b", "part", "side", "v", "label", "text").groupBy("b").applyInArrow(run, "u long, v long")


def star_links(docs: DataFrame, edges: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Those of the edges (u, v) that are links; each u is compared with its own, STAR_ROWS at a time."""
    sizes = edges.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("chunks"))
    part = F.xxhash64("u", "chunk").alias("part")
    spokes = edges.join(sizes, "u").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int")).select(part, F.lit(1).alias("side"), "v")
    hubs = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(part, F.lit(0).alias("side"), F.col("u").alias("v"))
    return verified(docs, T.written(spokes.union(hubs).withColumn("label", F.col("v"))), classes, rule, stars=True)


def linked_classes(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(s1, root) of every class that has a link."""
    entries = 16 * (classes.agg(F.sum("n")).first()[0] or 0)  # a set has about a third of its size in keys, and up to twice that near a border
    keyed = T.written(shared_keys(docs, rule, max(T.width(docs.sparkSession, 2), math.ceil(0.6 * entries / BUCKET_BYTES))))

    edges = keyed.filter("u != v").select("u", "v").distinct()
    first = T.written(star_links(docs, T.written(can_link(edges, classes, rule)), classes, rule))
    roots = T.written(components(first))

    # keys whose classes the first links leave in several components
    labelled = keyed.select("k", "v").distinct().join(roots.withColumnRenamed("node", "v"), "v", "left").select("k", "v", F.coalesce("root", "v").alias("label"))
    labelled = T.written(labelled)
    still = labelled.groupBy("k").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.count(F.lit(1)).alias("c")).filter("a != z and c > 2").select("k")
    apart = T.written(labelled.join(still, "k"))
    T.discard(keyed)
    T.discard(labelled)
    if apart.isEmpty():
        return roots.withColumnRenamed("node", "s1")
    blocks = components(key_blocks(apart, classes, rule))
    rows = T.written(dealt(blocks.withColumnRenamed("node", "v").withColumnRenamed("root", "block").join(apart.select("v", "label").distinct(), "v"), "block", BLOCK_ROWS).select("part", "side", "v", "label"))
    second = T.written(verified(docs, rows, classes, rule, stars=False))
    if second.isEmpty():
        return roots.withColumnRenamed("node", "s1")
    return components(first.union(second)).withColumnRenamed("node", "s1")


def _grouped(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The rows as ``classed`` gives them, and the classes: s1, s2, least (doc_id), copies, component_id, and whether the class is the first of its component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = T.written(classed(docs, rule))
    found = members.filter("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min("vector").alias("vector"), F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = T.written(found)
    linked = linked_classes(docs, classes, rule)
    classes = classes.select("s1", "s2", "least", "copies")
    top = classes.join(linked, "s1").groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "s1")).alias("top"))
    named = linked.join(top, "root").select("s1", F.col("top.least").alias("component"), (F.col("s1") == F.col("top.s1")).alias("first"))
    final = classes.join(named, "s1", "left").select("s1", "s2", "least", "copies", F.coalesce("component", "least").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))
    return members, final


def _of_classes(members: DataFrame, final: DataFrame) -> DataFrame:
    """The rows with sets, with the columns of their class.

    Classes of very many copies, of which there can be few, are looked up first, in a written
    table: its size is known, so it is broadcast if small. The rows of the others are shuffled.
    """
    members = members.filter("s1 is not null").select("doc_id", "n_shingles", "s1", "s2")
    large = T.written(final.filter(F.col("copies") > HOT_COPIES))
    rest = members.join(large.select("s1", "s2"), ["s1", "s2"], "left_anti").join(final.filter(F.col("copies") <= HOT_COPIES), ["s1", "s2"])
    return members.join(large, ["s1", "s2"]).unionByName(rest)


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles and component_id of every document (the least doc_id that links lead to)."""
    members, final = _grouped(docs, rule)
    names = ["doc_id", "n_shingles", "component_id"]
    return _of_classes(members, T.written(final)).select(names).unionByName(members.filter("s1 is null").withColumn("component_id", F.col("doc_id")).select(names))


def _with_digests(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows with the class digest of their text in _s1 and _s2, null for empty sets."""
    schema = StructType([*docs.schema.fields, StructField("_s1", LongType()), StructField("_s2", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole):
                d = [_digest(s) if len(s) else (None, None) for s in shingle_sets(b.column("text"), rule.n)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64())], [*b.schema.names, "_s1", "_s2"])

    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:  # noqa: B008
    """One row, with all its columns, of each component: one with the least doc_id (a null id is the last). Rows with empty sets stay.

    A row goes by its id and the digest of its text together, so other texts under its id stay.
    """
    members, final = _grouped(docs, rule)
    key = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.col("doc_id").isNull().alias("_none")]
    gone = _of_classes(members, T.written(final)).filter(~(F.col("first") & F.col("doc_id").eqNullSafe(F.col("least"))))
    gone = gone.select(*key, F.col("s1").alias("_s1"), F.col("s2").alias("_s2")).distinct()
    own = F.when(F.col("_s1").isNull(), F.monotonically_increasing_id()).alias("_own")  # keeps rows with empty sets apart
    rows = _with_digests(docs, rule).select("*", *key, own)
    left = rows.join(gone.hint("shuffle_hash"), ["_id", "_none", "_s1", "_s2"], "left_anti")
    return left.dropDuplicates(["_id", "_none", "_s1", "_s2", "_own"]).select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under links of 85 hundredths over 4-word shingles."""
    return join(T.table(spark, sf_dir, "documents"), Rule(4, 85))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES: dict[str, str] = {}
