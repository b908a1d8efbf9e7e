"""Best-fit packing of documents into fixed-length training sequences.

A document is tokenised, ended by an id, and cut into pieces only where it is longer than a
sequence. Pieces are dealt by a hash into groups of a bounded number of pieces, and each group
is packed on its own by vector best fit, largest first: a sequence has residual tokens,
documents and attention cost, and of those that can take a piece under every one of them, the
one with the least weighted residual norm (or the largest weighted dot product of residual and
demand) takes it. Grouping costs less than one part-filled sequence a group.

Defined cases: a null or empty text is the end id alone. Null ids, repeated rows and extra
columns are carried as any other row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waneline.llm import text as T

SEQUENCE = 4096
END_ID = 1
#: Of tokens, documents and attention cost in the score. Measured on 10,267 pieces of 2269.2 sequences' worth of tokens:
#: 2271 sequences whatever the last two weigh up to 0.5, and also with 128 documents at most; 2272 with 64.
WEIGHTS = (1.0, 0.1, 0.1)
GROUP_ROWS = 4096
#: Words whose ids a worker keeps; beyond that it starts anew.
CACHE_WORDS = 500_000
_SLOT_BITS = 20
#: New words encoded in one call.
_TOGETHER = 2000
#: The tokenizer parts ASCII letters and digits from these marks, and no mark of a call joins them.
_SPLIT = (np.array([i < 128 and chr(i).isalnum() for i in range(256)]), np.array([i < 128 and chr(i) in ".,;:!?" for i in range(256)]))


class Tokens:
    """Ids of texts by a tokenizer whose words never span ASCII white space and do not depend on what stands beyond it.

    Words are found and looked up by their 64-bit hashes as whole arrays; only words not seen
    before become strings and go through the tokenizer, whatever they are made of. A bounded
    number of words is kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hash = np.empty(0, np.uint64)  # sorted, with the entry of each
        self.entry = np.empty(0, np.int64)
        self.slot = np.zeros(1 << _SLOT_BITS, np.int32)  # one entry of each run of hashes, as a guess
        self.word = np.zeros(1, np.uint64)  # hash of each entry; entry 0 is void
        self.begin = np.zeros(1, np.int64)
        self.size = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, 0 if it has none."""
        at = self.slot[(h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)].astype(np.int64)
        missed = np.flatnonzero(self.word[at] != h)
        if len(missed) and len(self.hash):
            k = np.minimum(np.searchsorted(self.hash, h[missed]), len(self.hash) - 1)
            at[missed] = np.where(self.hash[k] == h[missed], self.entry[k], 0)
        else:
            at[missed] = 0
        return at

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _letter_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: a call for many, told apart by the ids that end a run."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        end = np.flatnonzero(self.final[ids]) + 1
        if len(end) != len(words) or end[-1] != len(ids):  # the tokenizer takes some letter for a mark
            return self._ids(words)
        return ids, np.diff(end, prepend=0)

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        """Distinct new words, by their hashes."""
        plain = np.array([w.isalpha() and "\u0130" not in w for w in words], bool)  # that letter's lower case ends in a mark
        order = np.argsort(plain, kind="stable")
        words, rest = [words[i] for i in order], int((~plain).sum())
        parts = [self._ids(words[:rest])] + [self._letter_ids(words[i : i + _TOGETHER]) for i in range(rest, len(words), _TOGETHER)]
        h, size = h[order], np.concatenate([n for _, n in parts])
        entry = len(self.word) + np.arange(len(h))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.word = np.concatenate([self.word, h])
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
        hashes, entries = np.concatenate([self.hash, h]), np.concatenate([self.entry, entry])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.entry = hashes[order], entries[order]
        self.slot[(h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = entry

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        data, off = T.buffer(texts)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # tokens that begin so heed case
            data = T.LOWER[data]
        w = T.words(data, off, split=_SPLIT)
        if len(self.word) > CACHE_WORDS:
            self.clear()
        at = self._find(w.hash)
        new = np.flatnonzero(at == 0)
        if len(new):
            h, first = np.unique(w.hash[new], return_index=True)
            first = new[first]
            self._learn(h, [data[a:z].tobytes().decode() for a, z in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)])
            at[new] = self._find(w.hash[new])
        n = self.size[at]
        stop = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.begin[at] - stop[:-1], n) + np.arange(stop[-1])]
        cut = stop[w.first].tolist()
        return [ids[i:j] for i, j in zip(cut, cut[1:], strict=False)]


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The tokenizer of a path, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def best_fit(length: np.ndarray, size: int = SEQUENCE, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Bin of each piece. ``max_cost`` bounds the sum of squared lengths of a bin (attention within pieces).

    Without ``max_docs`` and ``max_cost`` those capacities are what a full bin can hold at most: they then
    never keep a piece out, and take part in the score alone.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    cap = np.array([size, max_docs or size, max_cost or float(size) * size])
    demand = np.stack([length, np.ones(len(length)), length.astype(float) ** 2], axis=1) / cap
    w = np.asarray(weights)
    out = np.empty(len(length), np.int64)
    room = np.empty((1024, 3))  # residual share of each open bin
    name = np.empty(1024, np.int64)
    n_open = n_bins = 0
    least = 1 / size
    for i in np.argsort(-length, kind="stable"):
        d = demand[i]
        r = room[:n_open]
        fits = (r >= d - 1e-12).all(1) if n_open else np.empty(0, bool)
        if fits.any():
            score = ((r - d) ** 2 @ w) if rule == "norm" else -(r * d @ w)
            k = int(np.where(fits, score, np.inf).argmin())
        else:
            if n_open == len(room):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            k, n_open = n_open, n_open + 1
            room[k], name[k] = 1.0, n_bins
            n_bins += 1
        out[i] = name[k]
        room[k] -= d
        if room[k].min() < least / 2 and (room[k, 0] < least / 2 or room[k, 1] * cap[1] < 0.5 or room[k, 2] * cap[2] < 0.5):  # full: the last takes its place
            n_open -= 1
            room[k], name[k] = room[n_open], name[n_open]
    return out


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and salt (a row number that spreads repeated rows)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = tokens(vocabulary).encode, 0
        for whole in batches:
            for b in T.slices(whole):
                rows: list[tuple] = []
                for doc, own in zip(b.column("doc_id").to_pylist(), encode(b.column("text")), strict=True):
                    ids = np.append(own, np.uint32(END_ID)).astype("<u4")
                    for k in range(math.ceil(len(ids) / size)):
                        part = ids[k * size : (k + 1) * size]
                        rows.append((doc, k, k * size, len(part), zlib.crc32(part.tobytes()), salt))
                        salt += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def pack(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in each sequence)."""
    groups = max(1, math.ceil(docs.count() / GROUP_ROWS))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        length = group["length"].to_numpy()
        group["sequence_id"] = best_fit(length, size, max_docs, max_cost, weights, rule) + group["g"].to_numpy() * (1 << 32)
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns=["g", "salt"])

    return (
        pieces(docs, vocabulary, size)
        .withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)))
        .groupBy("g")
        .applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def vocabulary_path() -> str:
    """Place of the word_bpe_49k vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens."""
    return pack(T.table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
