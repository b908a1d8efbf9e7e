"""Licence scans: notices inside a line, and wrapped over lines of a longer text."""

import textwrap
from collections import Counter

import numpy as np

from waneline.llm import licenses

PROSE = "Some words of a page about nothing much, as they stand before and after what matters here. " * 6


def test_notices_within_longer_texts(spark):
    docs, want = [], set()
    for d, (name, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        docs += [(2 * d, f"{PROSE}\nPhoto by Anna of the long road, {t} And so on it went for a while, {PROSE}"), (2 * d + 1, PROSE + "\n" + "\n".join("# " + x for x in textwrap.wrap(t, 36)) + "\n" + PROSE)]
        n = len(licenses.normalised(t)) - 1
        want |= {(2 * d, name, 1.0, n), (2 * d + 1, name, 1.0, n)}
    docs += [(100, "Photo by Anna, licensed under CC BY 4.0."), (101, f"{PROSE} Released under the MIT License. {PROSE} Released under the MIT License. {PROSE}"), (102, PROSE), (103, None)]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert want <= {(d, name, dice, n) for d, _, name, dice, n in got}
    assert (100, 0, "CC-BY-4.0", 1.0, 5) in got and sorted(r for r in got if r[0] == 101) == [(101, 0, "MIT", 1.0, 4)] * 2 and not [r for r in got if r[0] > 101]
    assert all(line == 1 for d, line, *_ in got if d < 100 and d % 2 == 0)


def test_runs_are_the_best_there_are(spark):
    rng = np.random.default_rng(5)
    name, docs = "GPL-3.0-notice", []
    words = licenses.normalised(licenses.TEMPLATES[name])
    for d in range(40):  # notices with words left out, put in and said twice
        w = [x for x in words for _ in range(int(rng.choice(3, p=[0.02 * (d % 5), 1 - 0.03 * (d % 5), 0.01 * (d % 5)])))]
        for _ in range(d % 4):
            w.insert(int(rng.integers(len(w))), "other")
        around = [f"p{x}" for x in rng.integers(0, 99, 90)]
        docs.append((d, around[:45] + w + around[45:]))
    grams = Counter(licenses.bigrams(words))
    lo, hi = licenses.bounds(len(words) - 1, 0.8)
    want = {}
    for d, w in docs:
        g = licenses.bigrams(w)
        best = max(2 * (Counter(g[a : a + k]) & grams).total() / (k + len(words) - 1) for k in range(lo, hi + 1) for a in range(len(g) - k + 1))
        if best >= 0.8:
            want[d] = round(best, 6)
    df = spark.createDataFrame([(d, " ".join(w[:60]) + "\n" + " ".join(w[60:])) for d, w in docs], "doc_id long, text string")
    got = licenses.scan(df, {name: licenses.TEMPLATES[name]}).collect()
    assert {r["doc_id"]: r["dice"] for r in got} == want and len(got) == len(want) and 5 < len(want) < 40
