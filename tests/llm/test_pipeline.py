"""The pipeline's stages: what each decides on its own input, and the whole against brute force."""

import collections

import corpus_pipeline
from millrace.llm import common, quality_rules
from tests.llm import test_operators as brute
from tests.llm.samples import blank_words, documents, empty


def test_stages(spark, sf, tmp_path):
    docs, kept = documents(spark), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{i}"
        stage(spark, docs, sf).write.parquet(path)
        made = spark.read.parquet(path)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == docs.columns
        kept[name] = (docs.collect(), made.collect())
        docs = made

    before, after = kept["quality rules"]
    verdict = {(r.doc_id, r.n_words): r.kept for r in quality_rules.quality_measures(documents(spark)).collect()}
    assert len(after) == sum(verdict[r.doc_id, len(blank_words(r.text))] for r in before)

    before, after = kept["near-dedup"]
    want = {c for _, _, c in brute.groups(before, 5) if c is not None}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)

    before, after = kept["secret scans"]
    assert sorted(str(r.doc_id) for r in before) == sorted(str(r.doc_id) for r in after)
    assert not any(brute.spans_of(r.text) for r in after)

    before, after = kept["mixing"]
    _, target = brute.targets(before)
    words = collections.Counter()
    for r in after:
        words[r.source] += len(blank_words(r.text))
    assert all(abs(words[s] - t) <= 1 for s, t in target.items())

    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sum(r.length for r in after if not r.start) <= sum({(r.sequence_id, r.offset): r.length for r in after}.values())


def test_run_and_empty(spark, sf, tmp_path):
    made = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in common.documents(spark, sf).select("doc_id").collect()}
    assert {r.doc_id for r in made.select("doc_id").collect()} <= ids and made.count() > 0
    empty(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_run_equals_its_stages_on_odd_rows(spark, tmp_path):
    """Null ids, repeated rows and clashing columns through the whole run: as many ids of every document as by single stages."""
    documents(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")

    def ids(packed):
        total = collections.Counter()
        for r in packed.collect():
            total[r.doc_id] += r.length
        return total

    assert ids(corpus_pipeline.run(spark, f"file://{tmp_path}")) == ids(docs) != {}
