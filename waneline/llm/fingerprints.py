"""Document fingerprints by I-Match.

Terms are the words of a text. Their document frequencies over all documents are held in a
count-min table of a fixed size; its relative error does not depend on the number of
documents. Terms within a band of inverse document frequency are kept, sorted and made
distinct, and several random parts of the lexicon are hashed: each part of a level keeps a
given share of all terms, from a quarter to 1 in 4,096: a part is equal only if no term of it
changed, so sparse levels bear larger edits, of longer texts, and dense ones tell texts apart.
Parts of a quarter or more alone would bear hardly any edit of a third of a text. A fingerprint is the row of those hashes; the likeness of two is the share of equal
ones among the parts that hold a term of either text, at the level where it is largest.

Defined cases: a null text is empty, and all empty texts share one fingerprint, which is like
itself (1) and no other (0). A text with no term in the band keeps all its terms. Rows with
equal ids are ordered by their text; null ids come last. Extra columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waneline.llm import text as T

#: Share of documents that a kept term is in: idf = ln(1 / share) between 1.6 and 6.9.
BAND = (1e-3, 0.2)
BITS = 20  # columns of each of the two rows of the count-min table
ROWS = 2
#: Each level deals the lexicon into so many parts, of which it uses the first PARTS.
LEVELS = (4, 16, 64, 256, 1024, 4096)
PARTS = 16
#: Runs of neighbouring documents dealt to a task: several, so that tasks come out alike.
RUNS_A_TASK = 4
_SEEDS = [np.uint64(0xA0761D6478BD642F * (2 * k + 1) & ((1 << 64) - 1)) for k in range(len(LEVELS) + ROWS)]
_USED = [min(PARTS, n) for n in LEVELS]
N_HASHES = sum(_USED)


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each text, sorted within it, and the row of each."""
    w = T.words(*T.buffer(texts))
    row = w.doc()
    order = np.lexsort((w.hash, row))
    h, row = w.hash[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _columns(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(T.mix(h ^ _SEEDS[len(LEVELS) + k]) >> np.uint64(64 - bits)).astype(np.int64) for k in range(ROWS)]


def band_mask(docs: DataFrame, band: tuple[float, float] = BAND, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Which count-min columns hold terms of the band, as two bit fields per column, and the number of documents.

    Each task counts its documents into a table of 2 x 2**bits numbers and sends the columns
    in blocks; blocks are summed in Spark, and what the driver gets has a fixed size.
    """
    block = 1 << 15

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ROWS, 1 << bits), np.int32)
        n = 0
        for whole in batches:
            for b in T.slices(whole):
                n += b.num_rows
                for row, at in zip(table, _columns(_distinct(b.column("text"))[0], bits), strict=True):
                    row += np.bincount(at, minlength=1 << bits).astype(np.int32)
        if n:
            cells = table.reshape(-1, block)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array([n if i == 0 else 0 for i in range(len(cells))], pa.int64()), pa.array([zlib.compress(c.astype("<i8").tobytes(), 1) for c in cells], pa.binary())], ["at", "n", "c"])

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the blocks of one group of tasks; sorted by block, so one sum is held at a time."""
        at, n, total = None, 0, None
        for p in parts:
            for i, k, c in p.itertuples(index=False):
                if i != at:
                    if at is not None:
                        yield pd.DataFrame({"at": [at], "n": [n], "c": [zlib.compress(total.tobytes(), 1)]})
                    at, n, total = i, 0, np.zeros(block, "<i8")
                n, total = n + k, total + np.frombuffer(zlib.decompress(c), "<i8")
        if at is not None:
            yield pd.DataFrame({"at": [at], "n": [n], "c": [zlib.compress(total.tobytes(), 1)]})

    kind = "at int, n long, c binary"
    counted = docs.select("text").mapInArrow(count, kind)
    summed = counted.repartition(T.width(docs.sparkSession), "at").sortWithinPartitions("at").mapInPandas(add, kind).collect()
    table = np.zeros((ROWS << bits) // block * block, np.int64).reshape(-1, block)
    for r in summed:
        table[r["at"]] = np.frombuffer(zlib.decompress(r["c"]), "<i8")
    n = sum(r["n"] for r in summed)
    df = table.reshape(ROWS, 1 << bits)
    low, high = band[0] * n, band[1] * n
    return (df >= low).astype(np.uint8) | ((df <= high).astype(np.uint8) << 1), n


def fingerprint(texts: pa.Array, mask: np.ndarray) -> np.ndarray:
    """Hashes (rows by N_HASHES, 0 for a part without terms) of every text.

    The least of a term's two counts is its frequency: it reaches the lower bound if both
    do, and keeps to the upper one if either does.
    """
    bits = int(math.log2(mask.shape[1]))
    h, row = _distinct(texts)
    marks = [m[c] for m, c in zip(mask, _columns(h, bits), strict=True)]
    inside = ((marks[0] & marks[1] & 1) == 1) & (((marks[0] | marks[1]) & 2) == 2)
    none = np.bincount(row[inside], minlength=len(texts)) == 0
    keep = inside | none[row]
    h, row = h[keep], row[keep]
    out = np.zeros((len(texts), N_HASHES), np.uint64)
    first = 0
    for level, (parts, used) in enumerate(zip(LEVELS, _USED, strict=True)):
        u = T.mix(h ^ _SEEDS[level])
        part = (u & np.uint64(parts - 1)).astype(np.int64)
        chosen = np.flatnonzero(part < used)
        cell = row[chosen] * used + part[chosen]
        order = np.argsort(cell, kind="stable")  # terms stay sorted within a cell
        cell, value = cell[order], T.mix(u[chosen][order] + _SEEDS[level])
        if len(cell):
            begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sums = T.mix(np.add.reduceat(value, begin))
            out[cell[begin] // used, first + cell[begin] % used] = sums >> np.uint64(40) | np.uint64(1)
        first += used
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows; 1 for equal fingerprints."""
    out = np.zeros(len(a))
    first = 0
    for used in _USED:
        x, y = a[:, first : first + used], b[:, first : first + used]
        held = ((x != 0) | (y != 0)).sum(1)
        same = ((x == y) & (x != 0)).sum(1)
        out = np.maximum(out, np.where(held >= min(4, used), same / np.maximum(held, 1), 0))
        first += used
    return np.where((a == b).all(1), 1.0, np.minimum(out, 0.999999))


def _hex(rows: np.ndarray) -> list[str]:
    raw = rows.astype(">u4").view(np.uint8).reshape(len(rows), -1, 4)[:, :, 1:]
    return [r.tobytes().hex() for r in raw]


def neighbours(docs: DataFrame) -> DataFrame:
    """The documents in runs of descending doc_id, each run closed by a copy of the row that follows it.

    Runs are ranges of doc_id between quantiles, so a run is a bounded share of all rows. Only
    the ids at run borders (one per run) reach the driver.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs = RUNS_A_TASK * T.width(docs.sparkSession)
    found = docs.select(F.percentile_approx("doc_id", [(i + 1) / runs for i in range(runs - 1)], 10_000).alias("q")).first()["q"] if runs > 1 else []
    cuts = np.array(sorted({int(c) for c in found or []}), np.int64)

    def place(ids: pd.Series) -> np.ndarray:
        """Run 0 has the nulls and the smallest ids."""
        return np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).astype(np.int64), "left"))

    @F.pandas_udf("int")
    def run_of(ids: pd.Series) -> pd.Series:
        return pd.Series(place(ids))

    heads = sorted((r["run"], r["head"]) for r in docs.select("doc_id").groupBy(run_of("doc_id").alias("run")).agg(F.max("doc_id").alias("head")).collect())
    # the head of a run follows the run above it, and the head of all follows the lowest
    closes = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """Twice the run of a row; and for the head of a run, twice the run it closes, plus one."""
        own = ids.astype("Int64")
        return pd.Series([[2 * int(r)] + ([2 * closes[k] + 1] if (k := None if i is pd.NA else int(i)) in closes else []) for r, i in zip(place(ids), own, strict=True)])

    dealt = docs.select("doc_id", "text", F.explode(places("doc_id")).alias("_p"))
    return dealt.select("doc_id", "text", F.shiftright("_p", 1).alias("run"), (F.col("_p") % 2 == 1).alias("sentinel"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    docs = T.table(spark, sf_dir, "documents")
    mask, _ = band_mask(docs)
    shared = spark.sparkContext.broadcast(mask)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """All rows but the last have their next row after them in the same run, or are sentinels."""
            ids, texts, edited, nxt = [], [], [], []
            for (doc, t, group, sentinel), (_, t2, group2, _) in zip(rows, rows[1:], strict=False):
                if not sentinel:
                    assert group == group2
                    cut = len(t) // 3
                    ids.append(doc)
                    texts.append(t)
                    edited.append(t[: len(t) - cut] + t2[:cut])
                    nxt.append(t2)
            if not ids:
                return
            own = fingerprint(pa.array(texts, pa.large_string()), shared.value)
            changed = fingerprint(pa.array(edited, pa.large_string()), shared.value)
            # the next document's fingerprint is the next row's own, but for the last of a stretch
            other = np.roll(own, -1, axis=0)
            odd = [i for i, t in enumerate(nxt) if i + 1 == len(nxt) or texts[i + 1] is not t]
            if odd:
                other[odd] = fingerprint(pa.array([nxt[i] for i in odd], pa.large_string()), shared.value)
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.string()), pa.array(_hex(own), pa.string()), pa.array(_hex(changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, other))], names
            )

        for whole in batches:
            for b in T.slices(whole):
                for row in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("run").to_pylist(), b.column("sentinel").to_pylist(), strict=True):
                    held.append(row)
                    size += len(row[1])
                    if size > 1 << 20 and len(held) > 1:
                        yield from flush(held)
                        held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield from flush(held)

    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = neighbours(docs).repartition(T.width(spark), "run")
    return dealt.sortWithinPartitions(F.desc("run"), "sentinel", F.desc_nulls_last("doc_id"), "text").mapInArrow(run, kind)


QUERIES = {"op8_document_fingerprints": op8_document_fingerprints}
ORACLES: dict[str, str] = {}
