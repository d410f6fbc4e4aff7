"""Each stage of the pipeline against a plain version of its decision, on its own input."""

from collections import Counter

import corpus_pipeline
from haulmark.llm.common import materialize
from haulmark.llm.mixing import mix
from haulmark.llm.packing import WordTokenizer
from haulmark.llm.quality_classifier import quality_classifier
from haulmark.llm.quality_rules import RULES, Document
from haulmark.llm.queries import tokenizer_path
from tests.llm.test_joins import plain_join

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_stated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = materialize(stage(spark, docs, SF), "test-stage")
        if name != "packing":
            assert docs.columns == columns, name
    first, classified, ruled, single, mixed = inputs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_classifier(first, labels).filter("score >= 0.5").collect()}
    assert {r.doc_id for r in classified.collect()} == good

    def passes(text):
        doc = Document((text or "").encode())
        return not doc.base_failed and not any(rule.rejects(doc) for rule in RULES)

    assert {r.doc_id for r in ruled.collect()} == {r.doc_id for r in classified.collect() if passes(r.text)}
    groups = plain_join([(r.doc_id, r.text) for r in ruled.collect()], 5, 4, 5)
    assert sorted(r.doc_id for r in single.collect()) == sorted(key for key, _, least in groups if key == least)
    copies = {r.doc_id: r.copies for r in mix(single).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == copies
    import pyarrow as pa

    rows = mixed.collect()
    tokens = sum(len(ids) + 1 for ids in WordTokenizer(tokenizer_path())(pa.array([r.text for r in rows])))
    assert sum(r.length for r in docs.collect()) == tokens


def test_pipeline_on_odd_documents(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b", None, "s", 3)] + [(k, f"some plain words that repeat {k} " + " ".join(f"x{k}y{j}" for j in range(30)), "en", "s", 1) for k in range(5, 9)]
    rows += [(9, rows[-1][1], "en", "t", 1), (9, rows[-1][1], "en", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for documents in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        kept = documents
        for _, stage in corpus_pipeline.STAGES:
            kept = materialize(stage(spark, kept, str(tmp_path)), "test-odd")
        assert (kept.count() > 0) == (not documents.isEmpty())


def test_run_returns_pieces(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
