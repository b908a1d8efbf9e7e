"""Decontamination: how the benchmark is dealt for broadcasting changes no match."""

import math

from waneline.llm import decontaminate


def test_parts_do_not_change_matches(spark, monkeypatch):
    # Items 2k and 2k + 1 share their first half, so its shingles weigh less than those of one item alone.
    half = lambda k, s: [f"{s}{k}x{j}" for j in range(20)]
    texts = {2 * k + s: half(k, "both") + half(k, "ab"[s]) for k in range(12) for s in (0, 1)}
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "item_id long, text string")
    docs, d = [], 0
    for i, t in texts.items():
        for cut in (0, 2, 4, 6, 8):
            docs.append((d, " ".join([*t[cut:], *(f"own{d}x{j}" for j in range(30))])))
            docs.append((d + 1, " ".join([*t[: 40 - cut], *(f"own{d}x{j}" for j in range(30))])))
            d += 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for most, at_once in ((512, 8), (8, 8), (2, 8), (2, 1)):
        monkeypatch.setattr(decontaminate, "PART_ITEMS", most)
        monkeypatch.setattr(decontaminate, "PASS_PARTS", at_once)
        got[most] = sorted(tuple(r) for r in decontaminate.matches(df, items).collect())
        assert decontaminate.keep_clean(df, items).count() == len(docs) - len({r[0] for r in got[most]})
    assert got[512] == got[8] == got[2]
    # Document 2 lacks the first two words of item 0: two of its 16 shared shingles give way to two of no item.
    both, one = math.log(1 + 24 / 2), math.log(1 + 24)
    first = {(r[0], r[1]): r[2] for r in got[2]}[2, 0]
    assert first == round((14 * both + 20 * one) / (16 * both + 22 * one), 6)


def test_marks_beyond_ascii_part_words(spark):
    words = [f"wörd{k}" for k in range(24)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    quoted = "\u201c" + "\u2014".join(words[:12]) + "\u201d\u00a0\u00ab" + "\u2026 ".join(words[12:]) + "\u00bb"
    df = spark.createDataFrame([(5, "er sagte: " + quoted + " und ging"), (6, "nichts davon \u201chier\u201d"), (7, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in decontaminate.matches(df, items).collect()] == [(5, 1, 1.0)]
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(df, items).collect()) == [6, 7]
