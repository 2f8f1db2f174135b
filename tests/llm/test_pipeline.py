"""The pipeline's stages on a small corpus, each against what it must keep."""

import corpus_pipeline
from rasterloom.llm import decontaminate, jaccard_join, quality_classifier

FOLDER = "/root/testdata/sf0.001"


def test_stages(ready):
    docs = ready.read.parquet(f"{FOLDER}/documents.parquet")
    labels = ready.read.parquet(f"{FOLDER}/labels.parquet")
    bench = ready.read.parquet(f"{FOLDER}/benchmark.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(ready, docs, FOLDER).cache()
        assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    model = quality_classifier.fit(kept[0][0], labels)
    assert ids(kept[0][1]) == ids(quality_classifier.score(kept[0][0], model).filter("score >= 0.5"))
    classes = jaccard_join.jaccard_join(kept[1][0]).collect()
    assert ids(kept[1][1]) == {r["class_id"] for r in classes}
    assert all(r["n_links"] == 0 for r in jaccard_join.jaccard_join(kept[1][1]).collect())
    assert ids(kept[3][1]) == ids(kept[3][0]) - ids(decontaminate.find_items(kept[3][0], bench))
    packed = corpus_pipeline.STAGES[-1][1](ready, docs, FOLDER)
    assert ids(packed) == ids(docs)


def test_stages_on_odd_rows(ready):
    rows = [(None, "a b c d e f", "en", "s", 11), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 50, "en", "s", 100), (3, "x " * 50, "en", "s", 100)]
    docs = ready.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            assert stage(ready, d, FOLDER).count() >= 0
    near = corpus_pipeline.near_duplicates(ready, docs, FOLDER)
    assert sorted((r["doc_id"] or 0) for r in near.collect()) == [0, 1, 2, 3]
