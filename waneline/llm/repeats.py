"""Substring dedup: repeated windows of words become maximal removal intervals.

Every window of ``size`` consecutive words of a document has a Rabin-Karp hash. A window that
also starts earlier in the corpus (smaller doc_id, or earlier in the same document) marks all
its words for removal; overlapping marks merge into intervals.

Counting runs over all windows in two rounds, both shuffled as packed arrays. Within a window
the least hash of its runs of ``ANCHOR`` words is its anchor, and equal windows have equal
anchors. Round one counts anchors, about one for seven words; a window whose anchor is found
once in the corpus is the only one of its kind. Round two counts the hashes (96 bits) of all
other windows and finds the earliest place of each. Before each shuffle a task sends one entry
at most for each hash, so a passage shared by any number of documents stays small.

Defined cases: a null or empty text has no words, and its digest is that of the empty string.
Null ids come after all others, in an order of their texts' hashes. Rows that share an id and a text are the same place and do not
remove each other's words; the first occurrence stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waneline.llm import text as T

SIZE = 20
ANCHOR = 8
#: A task packs and sends what it has gathered at so many entries.
FLUSH = 1 << 20
_LAST = np.iinfo(np.int64).max
#: Null ids stand as so many of the largest numbers, by a hash of the text: no bucket gets all of them.
_NULLS = 1 << 20
#: Bytes of text in one bucket of documents, and of entries in one bucket of hashes.
BUCKET_BYTES = 1 << 26
_SEVERAL = np.iinfo(np.int64).min  # for several documents of one task
_SECOND = 0xC2B2AE3D27D4EB4F
_PACKED = pa.schema([("b", pa.int32()), ("kind", pa.int8()), ("h", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("p", pa.binary())])
_PACKED_SQL = "b int, kind tinyint, h binary, c binary, d binary, p binary"


def _slide(x: np.ndarray, k: int, op: np.ufunc) -> np.ndarray:
    """op over every k consecutive values."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x = op(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(w: T.Words, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of each window start (0 where no window of one document starts), document of each word; hash and place of every anchor."""
    doc = w.doc()
    none = np.empty(0, np.uint64)
    if len(w.hash) < size:
        return np.zeros(len(w.hash), np.uint64), doc, none, np.empty(0, np.int64)
    runs = T.mix(T.windows(w.hash, anchor)) | np.uint64(1)
    least = _slide(runs, size - anchor + 1, np.minimum)
    inside = doc[: len(least)] == doc[size - 1 :]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(size - anchor, np.uint64)
    chosen = np.flatnonzero(runs == _slide(np.concatenate([pad, least, pad]), size - anchor + 1, np.maximum))
    out = np.zeros(len(w.hash), np.uint64)
    out[: len(least)] = least
    return out, doc, runs[chosen], chosen


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the first key (then the rest), and where groups of the first begin."""
    order = np.lexsort(keys[::-1])
    first = keys[0][order]
    return order, np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.empty(0, np.int64)


def _pack(kind: int, bucket: np.ndarray, h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket, its entries as byte strings of the arrays."""
    if not len(bucket):
        return
    order, begin = _groups(bucket)
    cut = np.append(begin, len(order))
    cols = [x[order] for x in (h, c, d, p)]
    rows = list(zip(cut[:-1], cut[1:], strict=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[order][begin], pa.int32()), pa.array([kind] * len(rows), pa.int8()), *[pa.array([x[i:j].tobytes() for i, j in rows], pa.binary()) for x in cols]], schema=_PACKED
    )


def _unpack(t: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = [i for i, k in enumerate(t.column("kind").to_pylist()) if k == kind]
    join = lambda name, dtype: np.frombuffer(b"".join(t.column(name)[i].as_py() for i in rows), dtype)
    return join("h", np.uint64), join("c", np.uint32), join("d", np.int64), join("p", np.int32)


def _doc_bucket(d: np.ndarray, n: int) -> np.ndarray:
    return (T.mix(d.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def _hash_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (T.mix(h ^ np.uint64(_SECOND)) % np.uint64(n)).astype(np.int32)


def _nothing(n: int, dtype: type) -> np.ndarray:
    return np.zeros(n, dtype)


def _answers(hash_: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Entries packed by the bucket of their document (kind 1)."""
    yield from _pack(1, _doc_bucket(doc, n), hash_, check, doc, place)


def _local_anchors(h: np.ndarray, d: np.ndarray, n: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Of each hash one entry for the corpus; documents that already share it here are answered at once.

    Entries are (hash, document), once for every place, so a hash twice in a document counts as repeated.
    """
    if not len(h):
        return
    order, begin = _groups(h, d)
    h, d = h[order], d[order]
    count = np.diff(np.append(begin, len(h)))
    several = np.repeat(count > 1, count)
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    told = np.flatnonzero(several & fresh)
    yield from _answers(h[told], _nothing(len(told), np.uint32), d[told], _nothing(len(told), np.int32), n)
    carrier = np.where(count > 1, _SEVERAL, d[begin])
    k = len(begin)
    yield from _pack(0, _hash_bucket(h[begin], parts), h[begin], _nothing(k, np.uint32), carrier, _nothing(k, np.int32))


def removed(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """The documents by bucket (b, doc_id, text), and the packed answers that name the windows to remove, by the same buckets."""
    if size < ANCHOR:
        raise ValueError(f"windows have {ANCHOR} words or more")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_hash = max(T.width(docs.sparkSession), math.ceil(total / BUCKET_BYTES))  # buckets of hashes: entries take less room than the texts
    n = max(2 * T.width(docs.sparkSession), math.ceil(total / BUCKET_BYTES))  # buckets of documents

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        ds: list[np.ndarray] = []
        held = 0
        for whole in batches:
            for b in T.slices(whole):
                w = T.words(*T.buffer(b.column("text")))
                _, doc, h, at = anchors(w, size, ANCHOR)
                hs.append(h)
                ds.append(b.column("id").to_numpy()[doc[at]])
                held += len(h)
                if held > FLUSH:
                    yield from _local_anchors(np.concatenate(hs), np.concatenate(ds), n, n_hash)
                    hs, ds, held = [], [], 0
        if hs:
            yield from _local_anchors(np.concatenate(hs), np.concatenate(ds), n, n_hash)

    def shared_anchors(t: pa.Table) -> pa.Table:
        h, _, d, _ = _unpack(t, 0)
        out = [t.filter(pc.equal(t.column("kind"), 1)).combine_chunks()]
        if len(h):
            order, begin = _groups(h, d)
            h, d = h[order], d[order]
            count = np.diff(np.append(begin, len(h)))
            told = np.repeat((count > 1) | (d[begin] == _SEVERAL), count) & (d != _SEVERAL)
            out += [pa.Table.from_batches([x]) for x in _answers(h[told], _nothing(int(told.sum()), np.uint32), d[told], _nothing(int(told.sum()), np.int32), n)]
        return pa.concat_tables(out)

    def second_round(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = [_PACKED.empty_table()]
        want_h, _, want_d, _ = _unpack(told, 1)
        if texts.num_rows and len(want_h):
            order = np.lexsort((want_h, want_d))
            want_h, want_d = want_h[order], want_d[order]
            parts = []
            for b in texts.to_batches():
                for s in T.slices(b):
                    w = T.words(*T.buffer(s.column("text")))
                    if len(w.hash) < size:
                        continue
                    least, doc, _, _ = anchors(w, size, ANCHOR)
                    ids = s.column("id").to_numpy()
                    lo, hi = np.searchsorted(want_d, ids, "left"), np.searchsorted(want_d, ids, "right")
                    chosen = [np.empty(0, np.int64)]
                    for i in np.flatnonzero(hi > lo):
                        a, z = w.first[i], w.first[i + 1]
                        if z - a >= size:
                            mine, known = least[a : z - size + 1], want_h[lo[i] : hi[i]]
                            chosen.append(a + np.flatnonzero(known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine))
                    at = np.concatenate(chosen)
                    if len(at):
                        h1 = T.mix(T.windows(w.hash, size))[at]
                        h2 = (T.mix(T.windows(w.hash, size, _SECOND))[at] >> np.uint64(32)).astype(np.uint32)
                        parts.append((h1, h2, ids[doc[at]], (at - w.first[doc[at]]).astype(np.int32)))
            if parts:
                h1, h2, d, p = (np.concatenate(x) for x in zip(*parts, strict=True))
                later, first = _split(h1, h2, d, p)
                out += [pa.Table.from_batches([x]) for x in _answers(h1[later], h2[later], d[later], p[later], n)]
                out += [pa.Table.from_batches([x]) for x in _pack(0, _hash_bucket(h1[first], n_hash), h1[first], h2[first], d[first], p[first])]
        return pa.concat_tables(out)

    def _split(h1: np.ndarray, h2: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries with an earlier one of the same hash, and one earliest entry of each hash."""
        order = np.lexsort((p, d, h2, h1))
        a, c, e, g = h1[order], h2[order], d[order], p[order]
        begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        count = np.diff(np.append(begin, len(a)))
        later = (e != np.repeat(e[begin], count)) | (g != np.repeat(g[begin], count))
        return order[later], order[begin]

    def earlier_windows(t: pa.Table) -> pa.Table:
        h1, h2, d, p = _unpack(t, 0)
        out = [t.filter(pc.equal(t.column("kind"), 1)).combine_chunks()]
        if len(h1):
            later, _ = _split(h1, h2, d, p)
            out += [pa.Table.from_batches([x]) for x in _answers(h1[later], h2[later], d[later], p[later], n)]
        return pa.concat_tables(out)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(_doc_bucket(ids.to_numpy(np.int64), n))

    spread = F.lit(int(_LAST)) - F.pmod(F.xxhash64("text"), F.lit(_NULLS))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), spread).alias("id"), "text")
    first = docs.mapInArrow(first_round, _PACKED_SQL)
    told = first.groupBy("b").applyInArrow(shared_anchors, _PACKED_SQL)
    texts = docs.select(bucket("id").alias("b"), "doc_id", "id", "text")
    second = texts.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(second_round, _PACKED_SQL)
    return texts, second.groupBy("b").applyInArrow(earlier_windows, _PACKED_SQL)


def dedup(docs: DataFrame, size: int = SIZE, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless asked for) and the removal intervals (first word, end) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("intervals", pa.list_(pa.list_(pa.int64())))])

    def cut(texts: pa.Table, told: pa.Table) -> pa.Table:
        _, want_c, want_d, want_p = _unpack(told, 1)
        order = np.lexsort((want_p, want_d))
        want_c, want_d, want_p = want_c[order], want_d[order], want_p[order]
        out = [schema.empty_table()]
        for b in texts.to_batches():
            for s in T.slices(b):
                data, off = T.buffer(s.column("text"))
                w = T.words(data, off)
                ids = s.column("id").to_numpy()
                check = (T.mix(T.windows(w.hash, size, _SECOND)) >> np.uint64(32)).astype(np.uint32)
                lo, hi = np.searchsorted(want_d, ids, "left"), np.searchsorted(want_d, ids, "right")
                rows = []
                for i, doc in enumerate(s.column("doc_id").to_pylist()):
                    a, z = w.first[i], w.first[i + 1]
                    gone = np.zeros(z - a + 1, np.int32)
                    p, c = want_p[lo[i] : hi[i]], want_c[lo[i] : hi[i]]
                    ok = p <= z - a - size
                    p, c = p[ok], c[ok]
                    p = np.unique(p[check[a + p] == c]) if len(p) else p
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + size, -1)
                    mark = np.cumsum(gone)[:-1] > 0
                    keep = np.flatnonzero(~mark) + a
                    text = b" ".join(data[x:y].tobytes() for x, y in zip(w.start[keep], w.end[keep], strict=True))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                    rows.append((doc, int(z - a), int(mark.sum()), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None, edge.reshape(-1, 2).tolist()))
                if rows:
                    out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema))
        return pa.concat_tables(out)

    texts, told = removed(docs, size)
    return texts.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, intervals array<array<long>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every whole text of ``documents`` once repeated windows of 20 words go."""
    return dedup(T.table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES: dict[str, str] = {}
