"""Benchmark decontamination: item-sized windows of documents against benchmark items.

Words are lower-cased runs of letters and digits, shingles are five consecutive words (or all
of a shorter item) with their multiplicity, and a shingle weighs ln(1 + items / items that
have it), both counted over the whole benchmark. A window of a document has as many words as an item. Its weighted SimHash of 64 bits
is looked up in a multi-index: the fingerprints of the items of that size are split into four
blocks of 16 bits, and any within ``radius`` of a window's agrees with it in some block but
for radius // 4 bits at most, so all of them are found. Candidates are verified by the exact
weighted similarity, the sum of least weighted counts over the sum of greatest.

Windows that hold too little item weight to reach the threshold whatever the rest are not
hashed; that bound loses nothing.

Defined cases: a null or empty text or item matches nothing; a document shorter than an item
is one window. Null ids, repeated rows and extra columns pass through. Of equal similarities
the first window is reported. Empty tables give an empty result (or all documents as clean).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waneline.llm import text as T

SHINGLE = 5
THRESHOLD = 0.8
#: At similarity 0.8 about ten of 64 bits differ, with a deviation of three.
RADIUS = 20
BLOCKS = 4
#: Items of one index (about 0.1 MB each), and indexes of one pass over the documents: both bound what is collected and
#: broadcast at once. All indexes share the weights of the whole benchmark and so give the same matches, however many.
PART_ITEMS = 512
PASS_PARTS = 8
#: Marks beyond ASCII: anything but letters, digits and what combines with them.
_MARKS = r"[^\x00-\x7F\pL\pN\pM]"


def _words(texts: pa.Array) -> T.Words:
    texts = texts.fill_null("")
    odd = pc.match_substring_regex(texts, _MARKS)
    if pc.any(odd).as_py():
        texts = pc.if_else(odd, pc.replace_substring_regex(texts, _MARKS, " "), texts)
    return T.words(*T.buffer(pc.utf8_lower(texts)), separators=T.NON_WORD)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    return T.mix(T.windows(h, k) ^ np.uint64(k))


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted SimHash of each row of shingle hashes."""
    out = np.zeros(len(shingles), np.uint64)
    for bit in range(64):
        side = ((shingles >> np.uint64(bit)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out |= ((side * weights).sum(1) > 0).astype(np.uint64) << np.uint64(bit)
    return out


@dataclass
class Shared:
    """What all parts of a benchmark need of the whole: the number of items, and the shingles of two items or more with how many have them."""

    items: int
    hash: np.ndarray  # sorted
    have: np.ndarray


@dataclass
class Weights:
    """Weights of shingles over the whole benchmark, for one part of it.

    A shingle of one item weighs as much as one of none, so beside the part's own shingles only
    those of several items need to be known.
    """

    known: np.ndarray  # sorted
    weight: np.ndarray
    other: float
    coarse: np.ndarray  # which leading 20 bits any known shingle has

    def locate(self, h: np.ndarray) -> np.ndarray:
        """Place of each shingle among the known ones, -1 for those of no item."""
        out = np.full(h.shape, -1, np.int64)
        maybe = np.flatnonzero(self.coarse[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        hit = self.known[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out


@dataclass
class Group:
    """Items of one size: ids, shingles, weights, fingerprints, and the multi-index over them."""

    words: int
    k: int
    ids: list[int]
    bags: list[dict[int, int]]
    prints: np.ndarray
    member: np.ndarray  # which shingles of the part these items have
    least: float = 0.0
    index: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # per block: sorted values within reach of an item, and the items


def _balls(radius: int) -> np.ndarray:
    v = np.arange(1 << 16, dtype=np.uint32)
    return v[np.bitwise_count(v) <= radius]


@dataclass
class Part:
    """Some of the items, by size; its own shingles are places in the weights, sorted."""

    table: Weights
    own: np.ndarray
    groups: list[Group]
    radius: int
    threshold: float


def _bags(items: list[tuple[int, str | None]]) -> tuple[T.Words, list[dict[int, int]], list[int]]:
    """Words of the items, and for each its shingles with their number, and its size."""
    w = _words(pa.array([t for _, t in items], pa.string()))
    bags, sizes = [], []
    for i in range(len(items)):
        h = w.hash[w.first[i] : w.first[i + 1]]
        k = min(SHINGLE, len(h))
        runs = _runs(h, k).tolist() if k else []
        bag: dict[int, int] = {}
        for r in runs:
            bag[r] = bag.get(r, 0) + 1
        bags.append(bag)
        sizes.append(len(h))
    return w, bags, sizes


def weigh(own: np.ndarray, shared: Shared) -> Weights:
    """Weights of the sorted shingles of a part, and of those that several items share."""
    known = np.union1d(own, shared.hash)
    have = np.ones(len(known), np.int64)
    have[np.searchsorted(known, shared.hash)] = shared.have
    coarse = np.zeros(1 << 20, bool)
    coarse[known >> np.uint64(44)] = True
    return Weights(known, np.log(1 + shared.items / have), math.log(1 + shared.items), coarse)


def build(items: list[tuple[int, str | None]], shared: Shared, threshold: float = THRESHOLD, radius: int = RADIUS) -> Part | None:
    """Index of a bounded list of (item_id, text) under the weights of the whole benchmark; None if no item has a word."""
    w, bags, sizes = _bags(items)
    if not any(sizes):
        return None
    table = weigh(np.array(sorted({r for bag in bags for r in bag}), np.uint64), shared)
    own = table.locate(np.array(sorted({r for bag in bags for r in bag}), np.uint64))
    part = Part(table, own, [], radius, threshold)
    near = _balls(radius // BLOCKS)
    for size in sorted({s for s in sizes if s}):
        mine = [i for i, s in enumerate(sizes) if s == size]
        k = min(SHINGLE, size)
        rows = np.array([_runs(w.hash[w.first[i] : w.first[i + 1]], k) for i in mine])
        g = Group(size, k, [items[i][0] for i in mine], [bags[i] for i in mine], simhash(rows, table.weight[table.locate(rows.ravel())].reshape(rows.shape)), np.zeros(len(own), bool))
        totals = [sum(c * table.weight[np.searchsorted(table.known, np.uint64(r))] for r, c in bag.items()) for bag in g.bags]
        g.least = threshold * min(totals)
        g.member[np.searchsorted(own, table.locate(np.array([r for bag in g.bags for r in bag], np.uint64)))] = True
        for block in range(BLOCKS):
            v = ((g.prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.uint32)
            reach = (v[:, None] ^ near[None, :]).ravel()
            owner = np.repeat(np.arange(len(mine), dtype=np.uint16), len(near))
            order = np.argsort(reach, kind="stable")
            g.index.append((reach[order].astype(np.uint16), owner[order]))
        part.groups.append(g)
    return part


class Finder:
    """Matches of documents."""

    def __init__(self, b: Part):
        self.table, self.b = b.table, b

    def owned(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which known shingles are of this part, and where those are among its own."""
        at = np.minimum(np.searchsorted(self.b.own, place), len(self.b.own) - 1)
        mine = np.flatnonzero(self.b.own[at] == place)
        return mine, at[mine]

    def candidates(self, g: Group, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of every fingerprint pair within the radius, by the multi-index."""
        pairs = []
        for block, (values, items) in enumerate(g.index):
            v = ((marks >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.uint16)
            lo, n = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n -= lo
            owner = np.repeat(np.arange(len(marks)), n)
            pairs.append(owner * len(g.ids) + items[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(g.ids), pair % len(g.ids)
        distance = np.bitwise_count(marks[window] ^ g.prints[item]).astype(int)
        near = distance <= self.b.radius
        return window[near], item[near], distance[near]

    def similarity(self, bag: dict[int, int], weights: dict[int, float], item: dict[int, int]) -> float:
        """Sum of least weighted counts over sum of greatest."""
        both = most = 0.0
        for r, c in bag.items():
            both += weights[r] * min(c, item.get(r, 0))
            most += weights[r] * max(c, item.get(r, 0))
        for r, c in item.items():
            if r not in bag:
                most += c * float(self.table.weight[np.searchsorted(self.table.known, np.uint64(r))])
        return both / most if both >= self.b.threshold * most - 1e-12 else 0.0

    def search(self, runs: np.ndarray, place: np.ndarray, groups: list[Group], k: int) -> dict[int, tuple[float, int, int, int]]:
        """Best window of each item in one document: (similarity, first word, words, distance)."""
        best: dict[int, tuple[float, int, int, int]] = {}
        hit = np.flatnonzero(place >= 0)
        weights = np.full(len(runs), self.table.other)
        weights[hit] = self.table.weight[place[hit]]
        in_part, at_own = self.owned(place[hit])
        hit = hit[in_part]
        for g in groups:
            own = np.zeros(len(runs) + 1)
            own[hit + 1] = weights[hit] * g.member[at_own]
            own = np.cumsum(own)
            m = min(g.words - k + 1, len(runs))
            starts = np.flatnonzero(own[m:] - own[:-m] >= g.least - 1e-9)  # others hold too little of any item
            if not len(starts):
                continue
            lo, hi = starts[0], starts[-1] + m
            sides = np.unpackbits(np.ascontiguousarray(runs[lo:hi]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * 2.0 - 1
            total = np.concatenate([np.zeros((1, 64)), np.cumsum(sides * weights[lo:hi, None], axis=0)])
            marks = np.packbits(total[starts + m - lo] - total[starts - lo] > 0, axis=1, bitorder="little").view(np.uint64).ravel()
            for at, i, distance in zip(*self.candidates(g, marks), strict=True):
                s = int(starts[at])
                shingles = runs[s : s + m].tolist()
                bag: dict[int, int] = {}
                for r in shingles:
                    bag[r] = bag.get(r, 0) + 1
                x = self.similarity(bag, dict(zip(shingles, weights[s : s + m].tolist(), strict=True)), g.bags[i])
                if x and (g.ids[i] not in best or x > best[g.ids[i]][0]):
                    best[g.ids[i]] = (x, s, m + k - 1, int(distance))
        return best

    def __call__(self, texts: pa.Array, w: T.Words) -> list[list[tuple[int, float, int, int, int]]]:
        """For each text, of these words, its (item_id, similarity, first word, words, distance), best window of each item."""
        b = self.b
        best: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in range(len(texts))]
        for k in sorted({g.k for g in b.groups}):
            groups = [g for g in b.groups if g.k == k]
            if len(w.hash) < k:
                continue
            runs = _runs(w.hash, k)
            place = self.table.locate(runs)
            mine, _ = self.owned(place)
            held = np.zeros(len(runs) + 1)
            held[mine + 1] = self.table.weight[place[mine]]
            held = np.cumsum(held)
            begin = np.minimum(w.first[:-1], len(runs))
            last = np.maximum(np.minimum(w.first[1:] - k + 1, len(runs)), begin)  # one past the last run of each document
            for doc in np.flatnonzero((held[last] - held[begin] >= min(g.least for g in groups) - 1e-9) & (last > begin)):
                a, z = int(begin[doc]), int(last[doc])
                best[doc].update(self.search(runs[a:z], place[a:z], groups, k))
        return [[(i, *v) for i, v in sorted(x.items())] for x in best]


def _shared(items: DataFrame) -> Shared:
    """Counts over the whole benchmark, made in Spark; shingles of a single item stay there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, bags, _ = _bags([(0, t) for t in b.column("text").to_pylist()])
            hashes = [np.fromiter(bag, np.uint64, len(bag)).view(np.int64) for bag in bags]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]), pa.int64()), pa.array(np.repeat(0, sum(map(len, hashes))), pa.int32())], ["h", "items"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([sum(bool(bag) for bag in bags)], pa.int32())], ["h", "items"])

    counted = items.select("text").mapInArrow(count, "h long, items int").groupBy("h").agg(F.count(F.lit(1)).alias("have"), F.sum("items").alias("items"))
    got = counted.filter("h is null or have > 1").toArrow()
    n = pc.sum(got.column("items")).as_py() or 0
    got = got.filter(pc.is_valid(got.column("h")))
    h = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Shared(n, h[order], got.column("have").to_numpy()[order])


def passes(items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> Iterator[tuple[list[Part], bool]]:
    """Indexes for one pass over the documents after the other, at most PASS_PARTS of PART_ITEMS items each, and whether it is the last."""
    items = items.select("item_id", "text").filter("text is not null and item_id is not null")
    shared = _shared(items)
    n = max(1, math.ceil(items.count() / (PART_ITEMS * 0.8)))
    for first in range(0, n, PASS_PARTS):
        parts: dict[int, list] = {}
        place = F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("place")
        for r in items.select("item_id", "text", place).filter(F.col("place").between(first, first + PASS_PARTS - 1)).collect():
            parts.setdefault(r["place"], []).append((r["item_id"], r["text"]))
        built = [build(sorted(parts[k]), shared, threshold, radius) for k in sorted(parts)]
        yield [b for b in built if b is not None], first + PASS_PARTS >= n


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, similarity, start_word, n_words, distance.

    With more than one pass, what each finds is written before the next is built.
    """
    kind = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32())])
    spark = docs.sparkSession
    out = None
    for parts, last in passes(items, threshold, radius):
        shared = spark.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finders = [Finder(b) for b in shared.value]
            for whole in batches:
                for s in T.slices(whole):
                    ids, texts = s.column("doc_id").to_pylist(), s.column("text")
                    w = _words(texts)
                    rows = [(d, i, round(x, 6), a, n, h) for find in finders for d, found in zip(ids, find(texts, w), strict=True) for i, x, a, n, h in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
        if not last or out is not None:
            part = T.written(part)
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, that hold no item; what a pass keeps is written before the next."""
    spent = None
    for parts, last in passes(items, threshold, radius):
        shared = docs.sparkSession.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finders = [Finder(b) for b in shared.value]
            for whole in batches:
                for s in T.slices(whole):
                    w = _words(s.column("text"))
                    clean = np.ones(s.num_rows, bool)
                    for find in finders:
                        clean &= [not found for found in find(s.column("text"), w)]
                    yield s.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = T.written(docs)
            shared.destroy()
            if spent is not None:
                T.discard(spent)
            spent = docs
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in whole texts of ``documents``."""
    return matches(T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES: dict[str, str] = {}
