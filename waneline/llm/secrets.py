"""Secret scans: pattern findings, and a character convolutional network over further candidates.

Base findings are the fixed patterns of three kinds (assign, access, hex). Candidates are those
and every run of token characters, single full stops within it included, that is long enough
and not all inside base findings, whatever characters it has. A small convolutional network in
numpy reads each candidate with its context, left and right; its output is calibrated, and runs
above the threshold of their make become findings of the kind ``model``. Base findings are
scored too and always stay; the network only adds, and may overlap them.

Defined cases: a null or empty text has no findings. A text of any length is scanned whole.
Null ids, repeated rows and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from waneline.llm import text as T

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
MIN_TOKEN = 20
#: Makes of candidates, each with its threshold: letters and marks alone, runs with full stops, the rest.
MAKES = ("plain", "dotted", "mixed")
#: Whole columns are screened with these linear-time forms; each admits all that the exact pattern finds.
_SCREENS = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}", "[A-Za-z0-9+/_=.-]{20}")

LEFT, RIGHT = 32, 12


def base_findings(text: str, screens: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by start, then kind as listed; leftmost, non-overlapping within a kind."""
    out = []
    if screens[0]:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if screens[1]:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if screens[2]:
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Token runs of MIN_TOKEN characters or more that base findings do not cover from end to end."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in base:  # by start; what touches is one
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for m in _TOKEN.finditer(text):
        if m.end() - m.start() < MIN_TOKEN:
            continue
        at = bisect_right(starts, m.start()) - 1
        if at < 0 or ends[at] < m.end():
            out.append(m.span())
    return out


def make(candidate: str) -> int:
    """Place among MAKES."""
    return 1 if "." in candidate else 2 if any("0" <= c <= "9" for c in candidate) else 0


# --- the network -------------------------------------------------------------------------

_ALPHABET = 97  # printable ASCII, and one for the rest


def _codes(s: str) -> np.ndarray:
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 32
    return np.where((c >= 0) & (c < 95), c, 95)


def _encode(rows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Padded codes, and for each position its region: 0 padding, 1 left, 2 candidate, 3 right."""
    most = max(len(c) for _, c, _ in rows) + LEFT + RIGHT
    codes = np.full((len(rows), most + 4), _ALPHABET - 1)
    region = np.zeros((len(rows), most + 4), np.int8)
    for i, (left, cand, right) in enumerate(rows):
        x = _codes(left + cand + right)
        codes[i, 2 : 2 + len(x)] = x
        a, b = 2 + len(left), 2 + len(left) + len(cand)
        region[i, 2:a], region[i, a:b], region[i, b : 2 + len(x)] = 1, 2, 3
    return codes, region[:, 2:-2]


@dataclass
class SecretModel:
    """Embedding, one convolution of width 5, pooling by region, logistic output."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    bias: float
    raw: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # outputs, and the probability of each, rising
    probability: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    threshold: np.ndarray = field(default_factory=lambda: np.full(len(MAKES), 0.5))
    calibration_recall: np.ndarray = field(default_factory=lambda: np.zeros(len(MAKES)))

    def _forward(self, codes, region):
        emb = self.embed[codes]
        n, length = region.shape
        cols = np.concatenate([emb[:, k : k + length] for k in range(5)], axis=2)
        act = np.maximum(cols @ self.conv + self.conv_bias, 0)
        pools, args = [], []
        for r in (1, 2, 3):
            masked = np.where((region == r)[:, :, None], act, 0)
            args.append(masked.argmax(1))
            pools.append(masked.max(1))
        inside = (region == 2)[:, :, None]
        size = inside.sum(1)
        pools.append((act * inside).sum(1) / size)
        feats = np.concatenate(pools, axis=1)
        z = feats @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (cols, act, args, inside, size, feats)

    def score(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated probability that each (left, candidate, right) is a secret. Candidates are batched by length."""
        if not rows:
            return np.empty(0)
        out = np.empty(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][1]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 256 and len(rows[order[to]][1]) * (to - at) < 65536:
                to += 1
            out[order[at:to]] = self._forward(*_encode([rows[i] for i in order[at:to]]))[0]
            at = to
        return np.interp(out, self.raw, self.probability)

    def finds(self, candidates_: list[str], p: np.ndarray) -> np.ndarray:
        """Which candidates of these probabilities are findings."""
        return p >= self.threshold[[make(c) for c in candidates_]] if len(p) else np.zeros(0, bool)


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: outputs and the probability of each, by pooling neighbours that fall; a half-count of each class keeps ends off 0 and 1."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # weight, sum of labels, least and greatest output
    for x, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([1.0, v, x, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, t, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + t, pools[-1][2], hi]
    x = [v for w, t, lo, hi in pools for v in (lo, hi)]
    p = [v for w, t, lo, hi in pools for v in ((t + 0.5) / (w + 1),) * 2]
    return np.array([0.0, *x, 1.0]), np.maximum.accumulate(np.array([p[0], *p, p[-1]]))


def labelled_findings(n: int = 6000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Seeded labelled findings (left, candidate, right, label) for training.

    Secrets are random keys of usual alphabets and lengths, with or without a telling word to
    their left; the others are what scans mistake for keys: identifiers, paths, dates, serial
    numbers, long words with and without digits, version strings, rules of one character.
    """
    rng = np.random.default_rng(seed)
    pick = lambda a: a[int(rng.integers(len(a)))]
    draw = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = ["an", "er", "th", "ing", "con", "ment", "lich", "aux", "ción", "re", "ver", "tion", "el", "os", "data", "user", "page", "keit", "heit", "ung", "schaft", "pfl", "ver", "zu", "eux", "ouest", "ado", "ente"]
    words = lambda k: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(k))
    onsets, nuclei, codas = ["", *"bcdfghjklmnprstvwz", "br", "ch", "cr", "dr", "fl", "gr", "pl", "pr", "qu", "sch", "sh", "sp", "st", "str", "th", "tr"], ["a", "e", "i", "o", "u", "ai", "au", "ea", "ei", "ie", "io", "ou"], ["", "", "", *"lmnrst", "ck", "ft", "ll", "ng", "nt", "rs", "ss", "st", "tz"]
    spoken = lambda: "".join(pick(onsets) + pick(nuclei) + pick(codas) for _ in range(int(rng.integers(1, 4))))
    known = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))).replace("ó", "o")
    telling = ["key: ", "Authorization: Bearer ", "client_id=", "pwd ", "credential ", "access key ", "auth=", "sk_live_", "private ", "signature="]
    out = []
    for i in range(n):
        before, after = words(6)[-LEFT:], " " + words(3)
        if i % 2:
            kind = int(rng.integers(6))
            size = int(rng.integers(20, 65))
            cand = (".".join(draw(low + up + dig + "_-", int(rng.integers(8, 30))) + pick(dig + up) for _ in range(int(rng.integers(2, 4)))) + draw(low + dig, 6)) if kind == 4 else draw(low + up, size) if kind == 5 else (draw(low + up + dig, size) if kind == 0 else draw(low + up + dig + "+/", size - 1) + "=" if kind == 1 else draw(low + dig, size) if kind == 2 else draw(up + dig, size))
            left = (before + " " + pick(telling)) if rng.random() < 0.6 else before + " "
            out.append((left[-LEFT:], cand, after[:RIGHT], 1))
        else:
            kind = int(rng.integers(16))
            word = lambda: "".join(pick(syllables) for _ in range(3)).replace("ó", "o")
            if kind >= 12:  # with full stops
                names = lambda: "".join(pick((spoken, known))() for _ in range(int(rng.integers(1, 3))))
                cand = (
                    f"www.{names()}.{pick(['com', 'org', 'net', 'de', 'fr', 'es'])}/{names()}/{names()}" if kind == 12 else ".".join(names() for _ in range(5)) if kind == 13
                    else f"{names()}_{names()}-{draw(dig, 1)}.{draw(dig, 2)}.{draw(dig, 1)}.{pick(['tar', 'py', 'html', 'pdf'])}" if kind == 14 else f"{names()}.{names().capitalize()}{names()}"
                )
                cand += "" if len(cand) >= 20 else "/" + names() + "/" + draw(low, 20 - len(cand))
                out.append(((before + " ")[-LEFT:], cand, after[:RIGHT], 0))
                continue
            if kind >= 6:  # without digits, or with nothing else
                parts, joint, want = [pick((spoken, known))()], pick(("", "", "_", "-", "/")), int(rng.integers(20, 45))
                while len(joint.join(parts)) < want:
                    parts.append(pick((spoken, known))())
                style = int(rng.integers(4))
                parts = [x.capitalize() for x in parts] if style == 1 else [x.upper() for x in parts] if style == 2 else parts
                cand = pick("-=_/+xA0") * want if kind == 10 else draw(dig, want) if kind == 11 else joint.join(parts)
                cand = "/" + cand if joint == "/" and kind < 10 and rng.random() < 0.5 else cand
                cand += draw(dig, int(rng.integers(1, 3))) if kind == 9 else ""
                out.append(((before + " ")[-LEFT:], cand, after[:RIGHT], 0))
                continue
            cand = (f"{word()}_{word()}_{draw(dig, 3)}" if kind == 0 else f"/{word()}/{word()}/{draw(dig, 4)}/{word()}" if kind == 1 else f"{draw(dig, 4)}-{draw(dig, 2)}-{draw(dig, 2)}-{word()}-{word()}" if kind == 2 else f"id-{draw(dig, 18)}" if kind == 3 else word() + word() + word() + draw(dig, 3) if kind == 4 else f"{word()}-{draw(dig, 1)}-{draw(dig, 2)}-{draw(dig, 1)}-{word()}")
            cand = (cand + word() * 2)[: max(20, len(cand))] if len(cand) < 20 else cand
            out.append(((before + " ")[-LEFT:], cand, after[:RIGHT], 0))
    return out


def scanned(finding: tuple[str, str, str, int]) -> tuple[list[tuple[str, str, str]], bool]:
    """What a scan of the finding's text gives the network to read of it, and whether base findings cover it already."""
    left, cand, right, _ = finding
    text, s, e = left + cand + right, len(left), len(left) + len(cand)
    base = base_findings(text)
    covered = [(a, b) for a, b, _ in base if a <= s and e <= b]
    spans = covered or [(a, b) for a, b in candidates(text, base) if a <= s and e <= b]
    return [(text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT]) for a, b in spans], bool(covered)


def found_of(model: SecretModel, findings: list[tuple[str, str, str, int]]) -> np.ndarray:
    """Whether a scan reports all of each finding: by a pattern, or as a candidate above its threshold."""
    seen = [scanned(f) for f in findings]
    rows = [r for rows, _ in seen for r in rows]
    hit = iter(model.finds([c for _, c, _ in rows], model.score(rows)).tolist())
    return np.array([any([base, *[next(hit) for _ in rows]]) for rows, base in seen], bool)


def train(findings: list[tuple[str, str, str, int]] | None = None, recall: float = 0.98, epochs: int = 6, filters: int = 16, dims: int = 6, seed: int = 11) -> SecretModel:
    """Fit the network on labelled findings, two thirds of them; on the rest its output is calibrated by isotonic
    regression, and for each make of candidates the threshold is the highest probability that keeps ``recall``.

    All rest on what a scan of the findings' texts passes to the network; recall counts what it does not pass as missed.

    ``findings`` is a bounded driver-side list (some thousands); by default the seeded ones.
    """
    findings = labelled_findings() if findings is None else findings
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(findings))
    cut = len(order) * 2 // 3
    m = SecretModel(rng.normal(0, 0.3, (_ALPHABET, dims)), rng.normal(0, 0.25, (5 * dims, filters)), np.zeros(filters), np.zeros(4 * filters), 0.0)
    shown = [(*row, findings[i][3]) for i in order[:cut] for row in scanned(findings[i])[0]]
    params = ["embed", "conv", "conv_bias", "out", "bias"]
    first = {p: np.zeros_like(np.asarray(getattr(m, p), float)) for p in params}
    second = {p: np.zeros_like(v) for p, v in first.items()}
    step = 0
    for _ in range(epochs):
        for at in range(0, len(shown), 64):
            rows = shown[at : at + 64]
            y = np.array([r[3] for r in rows], float)
            codes, region = _encode([r[:3] for r in rows])
            p, (cols, act, args, inside, size, feats) = m._forward(codes, region)
            dz = (p - y) / len(y)
            grad = {"out": feats.T @ dz, "bias": dz.sum()}
            df = np.outer(dz, m.out).reshape(len(y), 4, filters)
            da = (df[:, 3] / size)[:, None, :] * inside
            b, f = np.arange(len(y))[:, None], np.arange(filters)[None]
            for r in range(3):
                np.add.at(da, (b, args[r], f), df[:, r] * (region[b, args[r]] == r + 1))
            da *= act > 0
            grad["conv"] = cols.reshape(-1, 5 * dims).T @ da.reshape(-1, filters)
            grad["conv_bias"] = da.sum((0, 1))
            dcols = da @ m.conv.T
            grad["embed"] = np.zeros_like(m.embed)
            for k in range(5):
                np.add.at(grad["embed"], codes[:, k : k + region.shape[1]], dcols[:, :, k * dims : (k + 1) * dims])
            step += 1
            for name in params:
                g = grad[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                setattr(m, name, getattr(m, name) - 0.01 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8))
    held = [findings[i] for i in order[cut:]]
    passed = [(row, f[3], base) for f in held for rows, base in [scanned(f)] for row in rows]
    y = np.array([label for _, label, _ in passed], float)
    if len(y):
        m.raw, m.probability = calibrate(m.score([row for row, _, _ in passed]), y)
    p = m.score([row for row, _, _ in passed])
    kind = np.array([make(row[1]) for row, _, _ in passed], int)
    by_pattern = np.array([base for _, _, base in passed], bool)
    missed = Counter(make(f[1]) for f in held if f[3] and not scanned(f)[0])
    for k in range(len(MAKES)):
        mine = np.sort(p[(kind == k) & (y == 1) & ~by_pattern])
        if len(mine):
            need = math.ceil(recall * (len(mine) + missed[k]))
            m.threshold[k] = mine[max(0, len(mine) - need)]
            m.calibration_recall[k] = (mine >= m.threshold[k]).sum() / (len(mine) + missed[k])
        else:  # no such secret is known: nearly certain ones alone
            m.threshold[k] = 0.9
    return m


@functools.cache
def trained() -> SecretModel:
    """The network of the seeded findings, fitted once in a process."""
    return train()


def findings_of(texts: pa.Array, model: SecretModel) -> tuple[list[list[tuple[int, int, str, float]]], np.ndarray]:
    """All findings of every text (start, end, kind, probability), by start, then kind as listed; and how many candidates the network read."""
    texts = texts.fill_null("")
    screens = [pc.match_substring_regex(texts, s).to_numpy(zero_copy_only=False) for s in _SCREENS]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(len(texts))]
    rows, places = [], []
    for i in np.flatnonzero(screens[0] | screens[1] | screens[2] | screens[3]):
        t = texts[i].as_py()
        base = base_findings(t, tuple(bool(s[i]) for s in screens[:3]))
        more = [(s, e, "model") for s, e in candidates(t, base)] if screens[3][i] else []
        for s, e, k in base + more:
            places.append((i, s, e, k))
            rows.append((t[max(0, s - LEFT) : s], t[s:e], t[e : e + RIGHT]))
    p = model.score(rows)
    for (i, s, e, k), x, found in zip(places, p.tolist(), model.finds([c for _, c, _ in rows], p).tolist(), strict=True):
        if k != "model" or found:
            out[i].append((s, e, k, x))
    for found in out:
        found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out, np.bincount([i for i, *_ in places], minlength=len(texts)) if places else np.zeros(len(texts), np.int64)


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """One row per document: doc_id, and findings as an array of (kind, start, end, probability) in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for whole in batches:
            for b in T.slices(whole):
                found = [[{"kind": k, "start": s, "end": e, "probability": p} for s, e, k, p in f] for f in findings_of(b.column("text"), shared.value)[0]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "findings"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, findings array<struct<kind:string,start:long,end:long,probability:double>>")


def digest(docs: DataFrame, model: SecretModel) -> DataFrame:
    """Per document: counts by base kind, the digest of the base spans, all spans in one string, how many the network added, and how many candidates it read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "n_scored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole):
                found, read = findings_of(b.column("text"), shared.value)
                count = lambda k, f=found: pa.array([sum(x[2] == k for x in row) for row in f], pa.int64())
                join = lambda row: ",".join(f"{k}:{s}:{e}" for s, e, k, _ in row)
                base = pa.array([hashlib.sha256(join([x for x in row if x[2] != "model"]).encode()).hexdigest() for row in found], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), count("assign"), count("access"), count("hex"), base, pa.array([join(r) for r in found], pa.string()), count("model"), pa.array(read, pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_scored long")


def redact(docs: DataFrame, model: SecretModel, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every finding in ``text`` replaced by ``mark``; n_chars follows where present.

    Overlapping findings are replaced as one. Texts without findings stay byte for byte.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(t: str, found: list[tuple[int, int, str, float]]) -> str:
        parts, at = [], 0
        for s, e, _, _ in found:
            if s >= at:
                parts += [t[at:s], mark]
            at = max(at, e)
        return "".join([*parts, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole):
                at = b.schema.get_field_index("text")
                texts = b.column(at)
                found = findings_of(texts, shared.value)[0]
                new = [clean(t, f) if f else t for t, f in zip(texts.to_pylist(), found, strict=True)]
                b = b.set_column(at, b.schema.field(at), pa.array(new, texts.type))
                n = b.schema.get_field_index("n_chars")
                if n >= 0:
                    sizes = pa.array([len(t) if f else old for t, f, old in zip(new, found, b.column(n).to_pylist(), strict=True)], b.column(n).type)
                    b = b.set_column(n, b.schema.field(n), sizes)
                yield b

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every whole text of ``documents``, as counts and digests."""
    return digest(T.table(spark, sf_dir, "documents"), trained())


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES: dict[str, str] = {}
