"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their leading parts of three to seven bytes, as
presence. The machine has a weight for each term and a short vector for each, whose products
are the weights of pairs, so that two terms that are harmless alone can count together.

Defined cases: a null or empty text, or one without known terms, scores the bias. Rows with a
null id are never learned from and count as not held out; labels of several rows with one id
are averaged and learned as toxic from one half. An empty table gives an empty result;
without labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waneline.llm import text as T
from waneline.llm.langid import fold, sampled

#: At most about so many labelled rows, and so many bytes of their texts, are learned from; rows are picked by a hash of the id.
TRAIN_ROWS = 8_000
TRAIN_BYTES = 1 << 24
#: Terms whose pairs are weighed before learning: the most frequent ones among toxic texts.
PAIR_TERMS = 2048
BITS = 20
HEADS = (3, 4, 5, 6, 7)


def terms(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every term of every text, and the row of each; a term may come more than once."""
    w = T.words(*T.buffer(pc.utf8_lower(texts.fill_null(""))), separators=T.NON_WORD, heads=HEADS)
    row = w.doc()
    shift = np.uint64(64 - bits)
    found = [(w.hash >> shift, row)]
    for h in w.heads.values():
        kept = h != 0
        found.append((h[kept] >> shift, row[kept]))
    return np.concatenate([x for x, _ in found]).astype(np.int64), np.concatenate([r for _, r in found])


@dataclass
class ToxicityModel:
    place: np.ndarray  # of each bucket among the learned ones, or -1
    weight: np.ndarray
    vector: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        bucket, row = terms(texts, self.bits)
        at = self.place[bucket]
        known = at >= 0
        pair = np.unique(row[known] * len(self.place) + at[known])  # presence, not counts
        row, at = pair // len(self.place), pair % len(self.place)
        return 1 / (1 + np.exp(-np.clip(self.logit(row, at, n), -30, 30)))

    def logit(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weight[at], n)
        for v in self.vector.T:
            x = v[at]
            z += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return z


NO_MODEL = ToxicityModel(np.full(1 << BITS, -1, np.int32), np.zeros(1), np.zeros((1, 1)), -40.0)


def _apart(p: np.ndarray, q: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Difference of the shares of p in n_pos and of q in n_neg rows, in standard errors."""
    p, q = (p + 0.5) / (n_pos + 1), (q + 0.5) / (n_neg + 1)
    return (p - q) / np.sqrt(p * (1 - np.minimum(p, 0.999)) / (n_pos + 1) + q * (1 - np.minimum(q, 0.999)) / (n_neg + 1))


def in_pairs(flat: np.ndarray, owner: np.ndarray, y: np.ndarray, terms_: np.ndarray, z: np.ndarray, seen: int, clear: float) -> np.ndarray:
    """Those of the terms that tell the classes apart together with another one, clearly better than either alone."""
    at = np.full(int(flat.max(initial=0)) + 1, -1, np.int32)
    at[terms_] = np.arange(len(terms_))
    col = at[flat]
    kept = col >= 0
    col, row = col[kept], owner[kept]
    both = [np.zeros((len(terms_), len(terms_)), np.float32) for _ in range(2)]
    for label in (0, 1):
        mine = np.flatnonzero(y == label)
        place = np.full(len(y), -1, np.int32)
        place[mine] = np.arange(len(mine))
        r, c = place[row], col
        r, c = r[r >= 0], c[place[row] >= 0]
        for lo in range(0, len(mine), 1024):
            a, z_ = np.searchsorted(r, [lo, lo + 1024])
            x = np.zeros((1024, len(terms_)), np.float32)
            x[r[a:z_] - lo, c[a:z_]] = 1
            both[label] += x.T @ x
    single = np.abs(z[terms_])
    found = np.zeros(len(terms_), bool)
    for lo in range(0, len(terms_), 256):  # some rows of the matrix at a time
        pair = np.abs(_apart(both[1][lo : lo + 256], both[0][lo : lo + 256], float(y.sum()), float(len(y) - y.sum())))
        strong = (pair > 2 * clear) & (pair > 1.5 * np.maximum(single[lo : lo + 256, None], single[None])) & (both[1][lo : lo + 256] + both[0][lo : lo + 256] >= seen)
        found |= strong.any(0)
        found[lo : lo + 256] |= strong.any(1)
    return terms_[found]


def fit(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, rank: int = 6, epochs: int = 25, seed: int = 3, bits: int = BITS, seen: int = 5, clear: float = 3.0) -> ToxicityModel:
    """Learn from the distinct term buckets of the texts, one after the other, and how many each has.

    Terms are learned that are in ``seen`` texts or more and whose share differs between the
    classes by more than ``clear`` standard errors, alone or together with another term; of
    the latter, pairs of the PAIR_TERMS most frequent terms of toxic texts are weighed.
    """
    y = np.asarray(y, float)
    if not len(y) or not y.any():
        return NO_MODEL
    size, n_rows = 1 << bits, len(sizes)
    owner = np.repeat(np.arange(n_rows, dtype=np.int32), sizes)
    pos, all_ = np.bincount(flat[np.repeat(y > 0, sizes)], minlength=size), np.bincount(flat, minlength=size)
    z = np.where(all_ >= seen, _apart(pos, all_ - pos, y.sum(), len(y) - y.sum()), 0)
    often = np.argsort(-pos, kind="stable")[:PAIR_TERMS]
    often = np.sort(often[pos[often] >= seen])
    chosen = np.union1d(np.flatnonzero(np.abs(z) > clear), in_pairs(flat, owner, y, often, z, seen, clear) if len(often) else often)
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    at, kept = place[flat], place[flat] >= 0
    at, owner = at[kept].astype(np.int64), owner[kept]
    begin = np.searchsorted(owner, np.arange(n_rows + 1))
    rng = np.random.default_rng(seed)
    m = ToxicityModel(place, np.zeros(max(1, len(chosen))), rng.normal(0, 0.02, (max(1, len(chosen)), rank)), float(np.log(y.mean() / (1 - min(y.mean(), 0.999)))), bits)
    w1, w2, v1, v2 = np.zeros_like(m.weight), np.zeros_like(m.weight), np.zeros_like(m.vector), np.zeros_like(m.vector)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n_rows)
        for lo in range(0, len(order), 256):
            mine = order[lo : lo + 256]
            sizes = begin[mine + 1] - begin[mine]
            r = np.repeat(np.arange(len(mine)), sizes)
            a = at[np.repeat(begin[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            err = 1 / (1 + np.exp(-np.clip(m.logit(r, a, len(mine)), -30, 30))) - y[mine]
            err /= len(mine)
            gw = np.bincount(a, err[r], len(m.weight)) + 2e-4 * m.weight
            gv = np.empty_like(m.vector)
            for k in range(rank):
                x = m.vector[a, k]
                gv[:, k] = np.bincount(a, err[r] * (np.bincount(r, x, len(mine))[r] - x), len(m.weight))
            gv += 1e-3 * m.vector
            step += 1
            rate = 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            w1, w2 = 0.9 * w1 + 0.1 * gw, 0.99 * w2 + 0.01 * gw * gw
            v1, v2 = 0.9 * v1 + 0.1 * gv, 0.99 * v2 + 0.01 * gv * gv
            m.weight -= rate * w1 / (np.sqrt(w2) + 1e-7)
            m.vector -= 0.3 * rate * v1 / (np.sqrt(v2) + 1e-7)
            m.bias -= 0.05 * err.sum()
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> ToxicityModel:
    """Learn from labelled rows (doc_id, toxic): about ``most`` of them or fewer, with about ``most_bytes`` of text or fewer, which bounds the broadcast and what reaches the driver."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("_y"))
    known = sampled(known, most)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > most_bytes:
        texts = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(most_bytes / total * (1 << 30)))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole):
                bucket, row = terms(b.column("text"))
                pair = np.unique(row * (1 << BITS) + bucket)
                cut = np.searchsorted(pair >> BITS, np.arange(b.num_rows + 1))
                each = (pair & ((1 << BITS) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array([each[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())], ["_y", "f"])

    got = texts.select("_y", "text").mapInArrow(featurize, "_y int, f binary").toArrow()
    order = got.sort_by([("_y", "ascending"), ("f", "ascending")])  # the same model whatever the order of the rows
    f = order.column("f")
    flat = np.frombuffer(b"".join(f.to_pylist()), np.int32)
    return fit(flat, pc.binary_length(f).to_numpy() // 4, order.column("_y").to_numpy())


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; reads nothing but doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(b.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole):
                yield b.filter(pa.array(shared.value.score(b.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def learned(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    """The model of the test tables: labels of four of five folds."""
    labels = T.table(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull() & ~fold(5, 0))
    return train(T.table(spark, sf_dir, "documents"), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    out = score(T.table(spark, sf_dir, "documents"), learned(spark, sf_dir))
    return out.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
