"""The ten operators against brute force, exact round trips, planted cases and held-out rows."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests_words import words
from waneline.llm import decontaminate, fingerprints, jaccard, langid, licenses, packing, repeats, secrets, toxicity, warc


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- 1 secret scans ----------------------------------------------------------------------


def brute_base(t):
    out = []
    for kind, pattern in (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, t or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_secrets_match_brute_force_and_the_network_adds(spark, documents, texts, odd, empty):
    model = secrets.train()
    assert (model.calibration_recall >= 0.95).all() and (model.threshold < 1).all()
    held = secrets.labelled_findings(600, seed=123)
    found, y = secrets.found_of(model, held), np.array([x[3] for x in held])
    by_pattern = np.array([secrets.scanned(x)[1] for x in held])  # those stay whatever the network says
    assert found[y == 1].mean() > 0.95 and (~found[(y == 0) & ~by_pattern]).mean() > 0.97
    for r in rows(secrets.digest(documents, model)):
        assert r["base_sha256"] == hashlib.sha256(brute_base(texts[r["doc_id"]]).encode()).hexdigest()
    tricky = ["token=secret: abcdefgh", "PassWord = 'hunter22'", "toKen=abcdefgh", "api_key:abc", "é token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "AKIA" + "A1" * 8 + " AKIAKIA", "see key: Zx81Qm4Tt7Lw09PdRk3BvN5y ok"]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(secrets.digest(df, model))}
    for i, t in enumerate(tricky):
        base = ",".join(x for x in got[i]["spans"].split(",") if x and not x.startswith("model"))
        assert base == brute_base(t)
    assert got[6]["spans"] == "model:9:33"
    clean = {r["doc_id"]: r["text"] for r in rows(secrets.redact(df, model))}
    assert clean[6] == "see key: [SECRET] ok" and clean[4] == "é [SECRET]" and clean[3] == tricky[3]
    assert secrets.digest(odd, model).count() == 11 and secrets.scan(empty, model).count() == 0 and secrets.redact(odd, model).columns == odd.columns


# --- 2 substring dedup -------------------------------------------------------------------


def brute_repeats(docs, size=20):
    seen, out = set(), {}
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_repeats_match_brute_force(spark, documents, texts, odd, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(repeats.dedup(documents, with_text=False))}
    assert got == brute_repeats(sorted(texts.items()))
    within = [(3, " ".join(map(str, [*range(25), *range(25), *range(30)]))), (1, " ".join(map(str, range(5, 28)))), (2, "x " * 50), (9, None), (7, " ".join(["y"] * 19))]
    df = spark.createDataFrame(within, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(repeats.dedup(df))}
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == brute_repeats(sorted(within))
    assert got[2]["intervals"] == [[1, 50]] and got[2]["kept_text"] == "x"
    twice = [r for r in rows(repeats.dedup(odd)) if r["doc_id"] in (5, 6)]
    assert sorted((r["doc_id"], r["n_words"] - r["n_removed"]) for r in twice) == [(5, 4), (5, 4), (6, 0)]
    assert repeats.dedup(empty).count() == 0


# --- 3 licence scans ---------------------------------------------------------------------


def test_licences_match_sql_and_bounds_lose_nothing(spark, sf, odd, empty):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    key = lambda r: (r["doc_id"], r["line"], r["license"], r["dice"], r["n_bigrams"])
    ours = sorted(key(r) for r in rows(licenses.op3_license_scan(spark, sf)))
    assert ours == sorted(key(r) for r in con.sql(licenses.ORACLES["op3_license_scan"]).df().to_dict("records")) and ours
    for n in (4, 11, 60):
        lo, hi = licenses.bounds(n, 0.8)
        assert all((2 * min(k, n) / (k + n) >= 0.8) == (lo <= k <= hi) for k in range(1, 3 * n))
    cover = set(licenses.cover(licenses.TEMPLATES, 0.8))
    for t in licenses.TEMPLATES.values():  # what has no screening word cannot reach the threshold
        left = [g for g in licenses.bigrams(licenses.normalised(t)) if not cover & set(g.split(" "))]
        n = len(licenses.bigrams(licenses.normalised(t)))
        assert 2 * len(left) / (len(left) + n) < 0.8
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


# --- 4 packing ---------------------------------------------------------------------------


def test_packing_is_exact_and_tight(documents, texts, odd, empty):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    plain = Tokenizer.from_file(path)
    got = rows(packing.pack(documents, path))
    want = {}
    for d, t in texts.items():
        ids = [*plain.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[d, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 4096) + 1
    strange = {r["doc_id"]: r["length"] for r in rows(packing.pack(odd, path)) if r["doc_id"] in (1, 2, 3)}
    assert strange == {1: 1, 2: 1, 3: 1} and packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    length = np.random.default_rng(0).integers(1, 400, 500)
    bins = packing.best_fit(length, 1024, max_docs=5, max_cost=200_000, rule=rule)
    for b in set(bins.tolist()):
        own = length[bins == b]
        assert own.sum() <= 1024 and len(own) <= 5 and (own.astype(float) ** 2).sum() <= 200_000 + 1e-6


# --- 5 decontamination -------------------------------------------------------------------


def test_leaks_match_brute_force(spark, sf, documents, texts, odd, empty):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bench = {r["item_id"]: norm(r["text"]) for r in items.collect()}
    bags = {i: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) for i, x in bench.items()}
    have = Counter(s for b in bags.values() for s in b)
    weight = lambda s: math.log(1 + len(bench) / have[s]) if s in have else math.log(1 + len(bench))
    holders = defaultdict(set)
    for i, b in bags.items():
        for s in b:
            holders[s].add(i)
    want = set()
    for d, t in texts.items():
        w = norm(t)
        sh = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i in {i for s in sh for i in holders.get(s, ())}:
            m = min(sum(bags[i].values()), len(sh))
            for a in range(len(sh) - m + 1):
                c = Counter(sh[a : a + m])
                both = sum(weight(s) * min(c[s], bags[i][s]) for s in c)
                if both and both >= 0.8 * sum(weight(s) * max(c[s], bags[i][s]) for s in {*c, *bags[i]}):
                    want.add((d, i))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.matches(documents, items))}
    assert got == want and got
    assert decontaminate.keep_clean(documents, items).count() == len(texts) - len({d for d, _ in want})
    hidden = "Before! " + " ".join(bench[0]).upper() + " and after"
    df = spark.createDataFrame([(1, hidden), (2, "short"), (3, " ".join(bench[1][: len(bench[1]) // 2]))], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.matches(df, items))} == {(1, 0)}
    assert decontaminate.matches(odd, items).count() == 0 and decontaminate.matches(empty, items).count() == 0
    assert decontaminate.keep_clean(odd, items.filter("false")).count() == 11


# --- 6 WARC ------------------------------------------------------------------------------


def test_warc_round_trip(spark, sf, tmp_path):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    key = lambda r: tuple(None if v != v else v for v in (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    assert sorted(map(key, rows(warc.op6_warc(spark, sf)))) == sorted(key(r) for r in con.sql(warc.ORACLES["op6_warc"]).df().astype(object).where(lambda x: x.notna(), None).to_dict("records"))
    page = "é" * 600 + "\r\n\r\nWARC/1.0\r\n"
    odd = [(1, "u", page), (5, "u", page), (None, None, page), (2, None, None), (3, "a\nb", "y" * 999), (3, "a\nb", "y" * 999)]
    warc.write(spark.createDataFrame(odd, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows(warc.read(spark, str(tmp_path / "w"))))
    n = len(page.encode())
    assert got == Counter([(1, n, "revisit", 5), (5, n, "response", None), (None, n, "revisit", 5), (2, 0, "response", None), (3, 999, "response", None), (3, 999, "response", None)])


def test_archives_of_every_tier_and_of_odd_tables(spark, tmp_path, monkeypatch):
    """Files are bounded in bytes, gaps of damaged files are rows, the shuffled join agrees with the broadcast one."""
    sizes = [0, 10, 1200, 1200, 5000, 5000, 90_000, 90_000, 90_000]
    table = [(k, f"u{k}", chr(97 + n % 7) * n, k) for k, n in enumerate(sizes)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string, _response long").coalesce(1)
    monkeypatch.setattr(warc, "FILE_TIERS", ((2000, 3), (20_000, 2), (None, 1)))
    plain = None
    for k, most in enumerate((100, 0)):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        warc.write(pages, str(tmp_path / f"w{k}"))
        got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or -1) for r in rows(warc.read(spark, str(tmp_path / f"w{k}"))))
        assert [x[:2] for x in got] == list(enumerate(sizes)) and plain in (None, got)
        plain = got
    files = [f for f in (tmp_path / "w0").rglob("part-*") if "tier=2" in str(f)]
    assert len(files) == 3 and max(f.stat().st_size for f in (tmp_path / "w0").rglob("part-*")) < 100_000
    biggest = max(files, key=lambda f: f.stat().st_size)
    biggest.with_name("." + biggest.name + ".crc").unlink()
    biggest.write_bytes(biggest.read_bytes()[:-700])
    assert [r["record_type"] for r in rows(warc.read(spark, str(biggest)))] == ["gap"]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(empty, str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def make(payload: bytes) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(payload).hexdigest().encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_recovers_what_follows_damage(packed):
    pieces = [make(bytes([65 + k]) * (50 + k)) for k in range(5)]
    if packed:
        pieces = [warc.member(p) for p in pieces]
        assert gzip.decompress(pieces[0]).startswith(b"WARC")
    broken = bytearray(pieces[2])
    broken[len(broken) // 2] ^= 0xFF
    data = pieces[0] + pieces[1] + bytes(broken) + pieces[3] + b"noise" + pieces[4][:-9]
    found = list(warc.salvage(data))
    good = [r.payload[:1] for r in found if isinstance(r, warc.Record)]
    gaps = [(g.start, g.end) for g in found if isinstance(g, warc.Gap)]
    a = len(pieces[0]) + len(pieces[1])
    b = a + len(broken)
    assert good == [b"A", b"B", b"D"] and gaps == [(a, b), (b + len(pieces[3]), len(data))]


# --- 7 language --------------------------------------------------------------------------


def test_language_of_held_out_rows(documents, odd, empty):
    model = langid.train(documents.filter(~langid.fold(4, 2)))
    got = {r["doc_id"]: r for r in rows(langid.identify(documents, model))}
    held = rows(documents.filter(langid.fold(4, 2)).select("doc_id", "lang"))
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    strange = {r["doc_id"]: r for r in rows(langid.identify(odd, model))}
    assert all(strange[k]["lang_pred"] == "und" and strange[k]["score"] == 0 for k in (1, 2, 3, 8)) and strange[7]["lang_pred"] != "und"
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in rows(langid.identify(odd, nothing))} == {"und"} and langid.identify(empty, model).count() == 0


# --- 8 fingerprints ----------------------------------------------------------------------


def test_language_is_the_largest_posterior_by_brute_force(texts):
    """Against sums over a dictionary of n-grams, term by term."""
    model = langid.LanguageModel(["de", "en"], np.random.default_rng(0).normal(-8, 2, ((1 << 16) + 1, 2)), np.log([0.9, 0.1]), 16)
    model.logp[-1] = 0
    some = [t for t in texts.values() if t][:60] + ["a", "é", "ab"]
    got, p = model.predict(some)
    for text, lang in zip(some, got, strict=True):
        total = model.prior.copy()
        for i in range(len(text.lower())):
            for k in (1, 2, 3):
                if i + k <= len(text.lower()):
                    total += model.logp[langid.grams([text.lower()[i : i + k]], 16)[0][0, k - 1]]
        assert lang == model.names[int(total.argmax())]
    assert ((p > 0) & (p <= 1)).all()
    odd_, _ = model.predict(["²", "½", "Ⅷ", "12 _ !", "", None, "ª", "1a", "x" * 0 + "7" * 100 + "é"])
    assert odd_[:6] == ["und"] * 6 and "und" not in odd_[6:]


def test_fingerprints_of_edited_texts(spark, sf, texts):
    got = {r["doc_id"]: r for r in rows(fingerprints.op8_document_fingerprints(spark, sf))}
    order = sorted(texts, reverse=True)
    for d, n in zip(order, [*order[1:], order[0]], strict=True):
        t, cut = texts[d], len(texts[d]) // 3
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + texts[n][:cut]).encode()).hexdigest()
    by = defaultdict(set)
    for d, t in texts.items():
        by[t].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)
    near, far = (np.array([r[k] for r in got.values()]) for k in ("near_edited", "near_next"))
    assert np.median(near) > 0.3 and np.median(far) < 0.1 and (near > far).mean() > 0.9


def test_fingerprints_of_odd_tables(spark, odd, empty, tmp_path):
    for name, df, n in (("odd", odd.select("doc_id", "text"), 11), ("one", odd.filter("doc_id = 7").select("doc_id", "text"), 1), ("none", empty.select("doc_id", "text"), 0)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = rows(fingerprints.op8_document_fingerprints(spark, str(tmp_path / name)))
        assert len(got) == n
        if name == "odd":
            blank = [r for r in got if r["doc_id"] in (1, 2, 3)]
            assert len({r["fingerprint"] for r in blank}) == 1


# --- 9 Jaccard join ----------------------------------------------------------------------


def brute_components(docs, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = words((t or "").translate(low))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def planted(seed, n_docs, share):
    """Families of near copies in chains, whose ends differ more than neighbours do."""
    rng = np.random.default_rng(seed)
    docs, k = [], 0
    for _ in range(n_docs // 12):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(3, 160)))]
        for _ in range(12):
            docs.append((k, " ".join(base)))
            k += 1
            base = list(base)
            for _ in range(max(1, int(len(base) * share)) if rng.random() < 0.8 else 0):
                base[int(rng.integers(len(base)))] = f"v{rng.integers(10**6)}"
    return docs


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, n, percent, monkeypatch):
    docs = planted(n, 240, 0.01)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_components(docs, n, percent)
    for small in (False, True):  # the second deals keys, stars and blocks into chunks
        if small:
            for name, most in (("KEY_ROWS", 5), ("BLOCK_ROWS", 7), ("STAR_ROWS", 3), ("LOCAL", 2), ("HOT_COPIES", 1)):
                monkeypatch.setattr(jaccard, name, most)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard.join(df, jaccard.Rule(n, percent)))} == want


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_of_whole_documents(spark, documents, texts, n, percent):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard.join(documents.where("doc_id < 500"), jaccard.Rule(n, percent)))} == brute_components([(d, t) for d, t in texts.items() if d < 500], n, percent)


def test_chains_whose_ends_share_keys_but_not_enough(spark, monkeypatch):
    """A line of texts, each near the next, and many texts with one common passage: the least class of a key is rarely a partner."""
    rng = np.random.default_rng(5)
    common = [f"c{x}" for x in range(40)]
    docs, words_ = [], [f"w{x}" for x in range(120)]
    for k in range(60):
        words_ = words_[6:] + [f"n{k}x{j}" for j in range(6)]
        docs.append((k, " ".join(words_)))
        own = [f"o{rng.integers(10**6)}" for _ in range(60)]
        docs.append((1000 + k, " ".join(common + own)))
        docs.append((2000 + k, " ".join(common + own[:-2])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute_components(docs, 4, 85)
    for most in (4096, 4):
        monkeypatch.setattr(jaccard, "KEY_ROWS", most)
        monkeypatch.setattr(jaccard, "LOCAL", most)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard.join(df, jaccard.Rule(4, 85)))} == want


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (5, 70)])
def test_keys_meet_for_every_linked_pair(n, percent):
    rule, rng = jaccard.Rule(n, percent), np.random.default_rng(1)
    table = rule.classes(1 << 14)
    odd = 0
    for k in range(3000):
        a = int(rng.integers(1, 400))
        if k % 3:
            s = np.unique(rng.integers(0, 1 << 63, a).astype(np.uint64))
        else:  # few groups of the first dealing have content
            s = np.unique(rng.integers(0, 1 << 60, a).astype(np.uint64))
        drop = int(rng.integers(0, max(1, a // 5) + 1))
        t = np.unique(np.concatenate([rng.permutation(s)[drop:], rng.integers(0, 1 << 60, int(rng.integers(0, drop + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if len(t) and 100 * both >= percent * (len(s) + len(t) - both) and len(s) + len(t) > 2 * both:
            odd += not k % 3
            assert np.intersect1d(jaccard.keys(s, rule, table), jaccard.keys(t, rule, table)).size
    assert odd > 50


def test_the_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(2)
    rule = jaccard.Rule(4, 85)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, int(rng.integers(20, 300))).astype(np.uint64)
        for _ in range(6):
            sets.append(np.unique(np.concatenate([rng.permutation(base)[int(len(base) * rng.random() * 0.2) :], rng.integers(0, 1 << 63, 2).astype(np.uint64)])))
    up = list(range(len(sets)))
    root = lambda i: i if up[i] == i else root(up[i])
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard.overlap_of(sets[i], sets[j]) >= rule.overlap(len(sets[i]), len(sets[j]))}
    for i, j in jaccard.link_within(sets, rule):
        assert (max(i, j), min(i, j)) in pairs
        up[root(i)] = root(j)
    assert pairs and all(root(i) == root(j) for i, j in pairs)


def test_join_of_odd_tables(odd, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard.join(odd))]
    assert len(got) == 11 and {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 4, 5), (6, 4, 5)} <= set(got)
    assert jaccard.join(empty).count() == 0 and jaccard.keep_one(odd).columns == odd.columns and jaccard.keep_one(odd).filter("doc_id = 6").count() == 0


# --- 10 toxicity -------------------------------------------------------------------------


def test_toxicity_of_held_out_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(toxicity.op10_toxicity(spark, sf))}
    held = [r for r in rows(spark.read.parquet(f"{sf}/labels.parquet")) if got[r["doc_id"]]["held_out"]]
    bad = [got[r["doc_id"]]["score"] for r in held if r["toxic"]]
    good = [got[r["doc_id"]]["score"] for r in held if not r["toxic"]]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.85 and np.mean(np.array(good) < 0.5) > 0.97
    trained = toxicity.learned(spark, sf)
    assert {r["doc_id"] for r in rows(toxicity.score(odd, trained))} == {1, 2, 3, None, 4, 5, 6, 7, 8, 9} and all(0 <= r["score"] <= 1 for r in rows(toxicity.score(odd, trained)))
    assert toxicity.keep_clean(odd, trained).columns == odd.columns and toxicity.keep_clean(empty, trained).count() == 0
    nothing = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.keep_clean(odd, nothing).count() == 11 and toxicity.score(empty, nothing).count() == 0


def flat(data):
    return np.concatenate(data), np.array([len(x) for x in data])


def test_pairs_count_beyond_single_terms():
    rng = np.random.default_rng(0)
    a, b, noise = rng.random(3000) < 0.5, rng.random(3000) < 0.5, rng.integers(100, 200, (3000, 3))
    data = [np.unique(np.r_[np.flatnonzero([x, y]), z]).astype(np.int32) for x, y, z in zip(a, b, noise, strict=True)]
    m = toxicity.fit(*flat(data), a & b, epochs=20)
    at = m.place[[0, 1]]
    z = m.logit(np.array([0, 1, 2, 2]), np.array([at[0], at[1], at[0], at[1]]), 3)
    assert z[2] > 0 > max(z[0], z[1])


def test_pairs_without_any_effect_of_their_own():
    """Toxic texts have both of two terms or neither, the others one: each term alone is as common in both classes."""
    rng = np.random.default_rng(4)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    data = [np.unique(np.r_[np.flatnonzero([x, y]), z]).astype(np.int32) for x, y, z in zip(a, b, rng.integers(100, 160, (4000, 5)), strict=True)]
    m = toxicity.fit(*flat(data), a == b, epochs=60)
    at = m.place[[0, 1]]
    assert (at >= 0).all()
    z = m.logit(np.array([0, 1, 2, 2]), np.array([at[0], at[1], at[0], at[1]]), 4)
    assert min(z[2], z[3]) > max(z[0], z[1])


def test_training_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda f, sizes, y: seen.append((len(sizes), len(f))))
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('word', id, ' and some more of it') as text")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    toxicity.train(docs, labels, most=2000)
    toxicity.train(docs, labels, most=2000, most_bytes=30_000)
    assert 1700 < seen[0][0] < 2300 and 500 < seen[1][0] < 1500


def test_texts_beyond_ascii_hash_alike():
    bucket, row = toxicity.terms(pa.array(["ÉTÉ x", "été X", None, ""]))
    assert sorted(bucket[row == 0]) == sorted(bucket[row == 1]) and not (row > 1).any()


def test_likeness_by_brute_force(texts):
    """Each hash equals exactly where the kept terms of its part are the same set; the likeness is the best share by level."""
    some = [t for t in texts.values() if t and len(t) > 200][:40]
    edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(some, some[1:] + some[:1], strict=True)]
    everything = np.full((2, 1 << 12), 3, np.uint8)  # all terms are in the band
    a, b = (fingerprints.fingerprint(pa.array(x, pa.large_string()), everything) for x in (some, edited))
    hashed = {w: fingerprints.T.words(*fingerprints.T.buffer(pa.array([w]))).hash[0] for t in [*some, *edited] for w in words(t)}
    for row, (s, t) in enumerate(zip(some, edited, strict=True)):
        best, first = 0.0, 0
        for level, (parts, used) in enumerate(zip(fingerprints.LEVELS, fingerprints._USED, strict=True)):
            mine = [[set() for _ in range(used)] for _ in range(2)]
            for side, text in enumerate((s, t)):
                for w in set(words(text)):
                    part = int(fingerprints.T.mix(np.array([hashed[w] ^ fingerprints._SEEDS[level]]))[0] % np.uint64(parts))
                    if part < used:
                        mine[side][part].add(w)
            same = [x == y for x, y in zip(*mine, strict=True)]
            held = [bool(x or y) for x, y in zip(*mine, strict=True)]
            assert [bool(x) for x in a[row, first : first + used] == b[row, first : first + used]] == same
            if sum(held) >= min(4, used):
                best = max(best, sum(x and y for x, y in zip(same, held, strict=True)) / sum(held))
            first += used
        want = 1.0 if (a[row] == b[row]).all() else min(best, 0.999999)
        assert fingerprints.likeness(a[row : row + 1], b[row : row + 1])[0] == pytest.approx(want)
