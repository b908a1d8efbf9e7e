"""One document of each group stays where ids repeat or are null."""

from collections import Counter

from waneline.llm import jaccard


def test_one_row_of_each_group_whatever_the_ids(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    near = text(3) + " more"
    docs = [(3, text(3), "a"), (7, near, "b"), (7, text(7), "c"), (8, text(8), "d"), (8, text(8) + " more", "e"), (9, text(9), "f"), (9, text(9), "f"), (None, text(9), "g"), (None, text(10), "h"), (None, text(10), "h"), (None, text(11), "i"), (12, "", "j"), (12, None, "k"), (12, "", "j")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = Counter(r["source"] for r in kept.collect())
    assert got["d"] + got["e"] == 1
    assert {k: n for k, n in got.items() if k not in "de"} == {"a": 1, "c": 1, "f": 1, "h": 1, "i": 1, "j": 2, "k": 1}
