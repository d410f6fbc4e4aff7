"""Stages of the pipeline on null and repeated keys."""

from collections import Counter, defaultdict

import corpus_pipeline
from haulmark.llm.mixing import mix
from tests.llm.test_joins import plain_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_takes_rows_of_one_key_by_their_size(spark):
    rows = [(None if k % 2 else 7, " ".join(f"w{k}" for _ in range(k % 90)), "en", "abc"[k % 3], k) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = Counter(r.n_chars for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    drawn = mix(docs).collect()
    assert taken == {r.n_chars: r.copies for r in drawn if r.copies}
    words = Counter()
    for source, text, number in ((r.source, r.text, taken[r.n_chars]) for r in drawn):
        words[source] += number * len(text.split())
    targets = {r.source: r.target for r in drawn}
    assert all(abs(words[s] - t) <= 0.02 * t for s, t in targets.items())


def test_one_document_of_each_group_under_null_and_repeated_keys(spark):
    def text(name, edits=0):
        return " ".join(f"{name}{k}" if k >= edits else f"edit{name}{k}" for k in range(60))

    rows = [(1, text("a")), (9, text("a", 1)), (9, text("b")), (9, text("b").upper()), (9, text("c", 1)), (9, text("c")), (5, text("d")), (5, text("d")),
            (None, text("a", 2)), (None, text("e")), (None, text("e")), (None, text("e", 1)), (None, text("f")), (None, None), (None, ""), (3, ""), (3, ""), (3, None), (4, text("c", 1)), (4, text("g"))]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, "").collect()]
    groups = defaultdict(list)
    letters = {t: (t or "").lower().removeprefix("edit")[:1] for _, t in rows}  # the texts are alike by their letter
    for key, t in kept:
        groups[letters[t]].append(key)
    assert {k: v for k, v in groups.items() if k} == {"a": [1], "b": [9], "c": [4], "d": [5], "e": [None], "f": [None], "g": [4]}
    assert sorted(groups[""], key=str) == [3, 3, None, None]
    assert sorted(key for key, n, least in plain_join([(i, t) for i, (_, t) in enumerate(kept)], 5, 4, 5) if key != least) == []
