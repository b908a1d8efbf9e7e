"""The pipeline: order of stages, columns, and what each decides."""

import corpus_pipeline
from waneline.llm.text import written


def test_stages(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    docs = documents
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == documents.columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0.6 * sizes[0]
    assert docs.filter("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_over_odd_and_empty_tables(spark, sf, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        kept = got.count()
        assert got.columns == odd.columns and 7 <= kept <= 11, name
        if name == "n-gram Jaccard join":  # the row that comes twice, and its copy under another id
            assert kept == 9 and got.filter("doc_id in (5, 6)").count() == 1
        else:
            assert kept == 11, name
        assert stage(spark, empty, sf).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf)
    per = {tuple(r) for r in packed.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).select("sum(length)").collect()}
    assert max(x for (x,) in per) <= 4096 and packed.select("doc_id").distinct().count() == 10
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
