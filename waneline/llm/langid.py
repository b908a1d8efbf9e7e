"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, buckets by languages, of a fixed size whatever the
corpus; it is broadcast and whole batches are scored with gathers and segment sums in numpy.

Defined cases: a null text, or one without any letter, is ``und`` with score 0. Rows with a
null id are never learned from and count as not held out. Repeated rows are scored alike; an
empty table gives an empty result; with nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waneline.llm import text as T

_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: At most about so many labelled rows are learned from; they are picked by a hash of the id.
TRAIN_ROWS = 20_000


def has_letter(t: str) -> bool:
    """Whether any code point is of a Unicode letter category; numerals such as \u00b2, \u00bd or \u2167 are not."""
    return any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t[64:]))


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams of code points of each lower-cased text; and the row of each. Bucket 2**bits is void."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    c = np.concatenate([*parts, np.zeros(2, np.uint32)]) if parts else np.zeros(2, np.uint32)
    size = len(c) - 2
    last = np.zeros(size + 2, bool)
    last[(np.cumsum(n) - 1)[n > 0]] = True
    shift = np.uint32(32 - bits)
    a, b, d = c[:size], c[1 : size + 1], c[2 : size + 2]
    h1 = (a + np.uint32(1)) * np.uint32(_MULT[0])
    h2 = (h1 ^ b) * np.uint32(_MULT[1]) + np.uint32(17)
    h3 = (h2 ^ d) * np.uint32(_MULT[2]) + np.uint32(29)
    out = np.empty((size, 3), np.int32)
    for k, h in enumerate((h1, h2, h3)):
        out[:, k] = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
    void = 1 << bits
    out[last[:size], 1] = void
    out[last[:size] | last[1 : size + 1], 2] = void
    return out, n


@dataclass
class LanguageModel:
    names: list[str]
    logp: np.ndarray  # (2**bits + 1, languages); the void bucket holds zeros
    prior: np.ndarray
    bits: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of the largest posterior, and a score: its posterior with the evidence tempered to 40 n-grams' worth, so that scores can differ from 0 and 1."""
        plain = [t or "" for t in texts]
        known = np.array([has_letter(t) for t in plain], bool) & bool(self.names)
        if not self.names or not plain:
            return ["und"] * len(plain), np.zeros(len(plain))
        idx, n = grams(plain, self.bits)
        ll = np.zeros((len(plain), len(self.names)))
        if len(idx):
            per = self.logp[idx[:, 0]] + self.logp[idx[:, 1]] + self.logp[idx[:, 2]]
            full = np.flatnonzero(n)
            ll[full] = np.add.reduceat(per, (np.cumsum(n) - n)[full], axis=0)
        best = (ll + self.prior).argmax(1)
        tempered = ll * (np.minimum(n, 40) / np.maximum(n, 1))[:, None] + self.prior
        tempered = np.exp(tempered - tempered.max(1, keepdims=True))
        p = tempered[np.arange(len(plain)), best] / tempered.sum(1)
        return [self.names[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p, 0.0)


def sampled(df: DataFrame, most: int) -> DataFrame:
    """All rows if they are ``most`` at most, else about as many, picked by a hash of doc_id."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def train(labelled: DataFrame, bits: int = 16, smooth: float = 0.5, most: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows with a language. Each task counts n-grams by language; the counts are summed in Spark by language and block of buckets."""
    block = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for whole in batches:
            for b in T.slices(whole):
                langs = np.array(b.column("lang").to_pylist(), object)
                texts = np.array(b.column("text").to_pylist(), object)
                for lang in set(langs):
                    own = [t for t in texts[langs == lang] if t]
                    c = np.bincount(grams(own, bits)[0].ravel(), minlength=(1 << bits) + 1)[: 1 << bits]
                    sums[lang] = sums.get(lang, 0) + c
                    docs[lang] = docs.get(lang, 0) + int((langs == lang).sum())
        for lang, c in sums.items():
            for at in range(0, len(c), block):
                yield pa.RecordBatch.from_pydict({"lang": [lang], "at": [at], "docs": [docs[lang] if at == 0 else 0], "c": [[int(x) for x in c[at : at + block]]]}, schema)

    schema = pa.schema([("lang", pa.string()), ("at", pa.int32()), ("docs", pa.int64()), ("c", pa.list_(pa.int64()))])
    rows = sampled(labelled.filter("text is not null and lang is not null"), most).select("text", "lang").mapInArrow(count, "lang string, at int, docs long, c array<long>")
    total = (
        rows.select("lang", "at", "docs", F.posexplode("c").alias("k", "v"))
        .filter("v > 0 or docs > 0")
        .groupBy("lang", (F.col("at") + F.col("k")).alias("bucket"))
        .agg(F.sum("v").alias("v"), F.sum(F.when(F.col("k") == 0, F.col("docs")).otherwise(0)).alias("docs"))
        .toPandas()
    )
    names = sorted(total["lang"].unique())
    counts = np.zeros((1 << bits, len(names)))
    docs = np.zeros(len(names))
    for j, lang in enumerate(names):
        own = total[total["lang"] == lang]
        counts[own["bucket"].to_numpy(), j] = own["v"]
        docs[j] = own["docs"].sum()
    logp = np.log((counts + smooth) / (counts + smooth).sum(0)) if names else counts
    return LanguageModel(names, np.vstack([logp, np.zeros((1, len(names)))]), np.log(np.maximum(docs, 1) / max(docs.sum(), 1)) if names else docs, bits)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; reads nothing but doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, most=1 << 19):
                lang, p = shared.value.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(n: int, rest: int):
    """Whether crc32 of doc_id as text leaves ``rest`` modulo n (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == rest, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of ``documents``, learned from three of four folds."""
    docs = T.table(spark, sf_dir, "documents")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~fold(4, 2)))
    return identify(docs, model).select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
