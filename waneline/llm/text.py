"""Vectorised word hashing over Arrow string batches, and the Spark plumbing around it.

Texts are hashed as whole UTF-8 buffers with numpy: a word's hash is a polynomial of its
bytes modulo 2**64, read off a running sum, then mixed. No Python object is made per word.
Equal byte sequences always hash alike; different ones collide with a chance near 2**-64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1

#: ASCII white space: space and 0x09-0x0D. No byte of a longer UTF-8 sequence is among them.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NON_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: Lower-cases A-Z only.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & _M64, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Table:
    """Powers of the byte base and of its inverse, grown as needed and kept by the worker."""

    up = np.empty(0, np.uint64)
    down = np.empty(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            cls.up, cls.down = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
        return cls.up, cls.down


@dataclass
class Words:
    """Words of a batch in order: hash, byte span, and where each document's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(docs) + 1 positions into the arrays above
    heads: dict[int, np.ndarray]  # by length: hash of that many leading bytes, 0 for words not longer

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the offsets of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = (texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts).fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False, heads: tuple[int, ...] = (), split: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Split every document at separator bytes and hash the words (and leading parts of them).

    ``split`` parts a word further wherever a byte of its first set is followed by one of its second.
    """
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(off), np.int64), {k: none.astype(np.uint64) for k in heads})
    data = LOWER[data] if lower else data
    gap = np.ones(n + 1, bool)
    gap[1:] = separators[data]
    word = ~gap[1:]
    begins = word & gap[:-1]
    ends = word.copy()
    ends[:-1] &= gap[2:]
    if split is not None:
        apart = np.flatnonzero(split[0][data[:-1]] & split[1][data[1:]])
        ends[apart], begins[apart + 1] = True, True
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = word[inner]  # documents stand next to each other with nothing between
    ends[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = np.empty(len(start), np.uint64)
    parts = {k: np.zeros(len(start), np.uint64) for k in heads}
    at = 0
    while at < len(start):  # words of about CHUNK_BYTES at a time keep the temporaries small
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, "right")))
        lo, hi = int(start[at]), int(end[to - 1])
        up, down = _Table.get(hi - lo + 1)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        h[at:to] = (total[e] - total[s]) * down[s] ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k, part in parts.items():
            longer = np.flatnonzero(e - s > k)
            x = s[longer]
            part[at + longer] = mix((total[x + k] - total[x]) * down[x] ^ np.uint64(k * 0x9FB21C651E98DF25 & _M64))
        at = to
    return Words(mix(h), start, end, np.searchsorted(start, off).astype(np.int64), parts)


def windows(h: np.ndarray, k: int, base: int = 0xF1357AEA2E62A9C5) -> np.ndarray:
    """Rabin-Karp hashes of every k consecutive values (len(h) - k + 1 of them), unmixed."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    base |= 1
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    return (total[k:] - total[:-k]) * powers(pow(base, -1, 1 << 64), len(h) - k + 1)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes at most (one row at least)."""
    at = batch.schema.get_field_index(column)
    off = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's checkpoint folder, for tables that cut lineage.

    The folder is ``spark.checkpoint.dir``, or the one set on the context. Where there is
    neither, a local session (tests) uses the temp folder; a cluster would lose what it wrote
    there, so that is an error.
    """
    import tempfile
    import uuid

    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        root = f"file://{tempfile.gettempdir()}/waneline-checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: cuts lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote of a table that nothing reads any more."""
    path, jvm = df._written_to, df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession, times: int = 1) -> int:
    """Number of partitions for an explicit shuffle: follows spark.sql.shuffle.partitions."""
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))
