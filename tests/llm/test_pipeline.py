import corpus_pipeline
from podia.llm import mixing

from .cases import documents, empty
from .test_text_models import corpus


def test_stages_take_effect(spark):
    rows = corpus(60) + [(100, "alpha  beta gamma", "xx", "s"), (101, "alpha beta gamma", "xx", "t"), (102, "123", None, "t"), (103, None, "xx", None)]
    docs = documents(spark, rows)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        docs = docs.persist()
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name == "language ID":
            assert not {r.doc_id for r in docs.collect()} & {102, 103}
        if name == "exact dedup":
            assert 101 not in {r.doc_id for r in docs.collect()} and 100 in {r.doc_id for r in docs.collect()}
        if name == "mixing sources":
            plan = {r.source: r.target for r in mixing.targets(mixing.sizes(before)).collect()}
            got = {}
            for r in docs.collect():
                got[r.source] = got.get(r.source, 0) + len(r.text.split())
            assert all(abs(got.get(s, 0) - t) <= 3 for s, t in plan.items())
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] == counts[5] > 0
    assert all(r.same and len(r.ids) == r.n_pieces for r in docs.collect())


def test_empty_documents(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
