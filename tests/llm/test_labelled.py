"""The sample that models are fitted on is bounded in rows."""

from haulmark.llm.common import labelled


def test_repeated_keys_give_one_row(spark):
    learnable = [k for k in range(60)]
    docs = [(k, f"text {k}") for k in learnable] + [(k, f"other {k} {j}") for k in learnable[:20] for j in range(30)] + [(None, "x"), (4, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in learnable] + [(3, 1), (4, None)], "doc_id long, quality int")
    found = labelled(docs, labels, "quality", 25).collect()
    assert len(found) == 25 and len({r.doc_id for r in found}) == 25
    known = {tuple(r) for r in docs.collect()}
    assert all((r.doc_id, r.text) in known and r.label == r.doc_id % 2 for r in found)
    again = labelled(docs.repartition(7), labels, "quality", 25).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)
