"""Quality rules, quality classifier and toxicity against plain counts, and on odd rows."""

import random
import time
import zlib

import numpy as np
import pytest

from haulmark.llm import toxicity as tox
from haulmark.llm.common import held_out, repeated_words
from haulmark.llm.quality_classifier import STATISTICS, fit, quality_classifier, statistics
from haulmark.llm.quality_rules import RULES, Document, measure, ordered, quality_rules

DOCS = "doc_id long, text string, score string, kept int, held_out string"
LABELS = "doc_id long, quality int, toxic int"


def odd_documents(spark):
    rows = [(None, None, "x", 1, "h"), (1, "", "x", 1, "h"), (2, " \t\n\r\x0b\x0c ", "x", 1, "h"), (3, "word", "x", 1, "h"),
            (4, "long " * 200_000, "x", 1, "h"), (5, "same same", "x", None, None), (5, "same same", "x", None, None), (6, "  ", None, 1, "h")]
    return spark.createDataFrame(rows, DOCS)


def plain_repeats(words, window=5):
    marks = set()
    for i in range(len(words) - window + 1):
        for j in range(len(words) - window + 1):
            if i != j and words[i:i + window] == words[j:j + window]:
                marks |= set(range(i, i + window))
    return len(marks)


def test_repeated_words_equal_plain_count():
    rng = random.Random(1)
    for size in (0, 4, 5, 6, 30, 120):
        for letters in (1, 2, 3, 40):
            words = [bytes([97 + rng.randrange(letters)]) for _ in range(size)]
            assert repeated_words(words) == plain_repeats(words)


def test_repeated_words_stay_exact_with_many_different_words():
    words = [str(k).encode() for k in range(9000)]
    assert repeated_words(words) == 0
    assert repeated_words(words + words[100:105]) == 10


def test_counts_of_one_document():
    doc = Document("Äb #x\nline one\nline one\n\n \n".encode())
    assert (doc.n_words, doc.word_chars, doc.n_symbols, doc.n_lines, doc.n_dup_lines) == (6, 18, 1, 3, 1)
    assert doc.base_failed


def test_order_of_rules_follows_rejections_per_cost():
    figures = {"symbols": (1.0, 0.1), "shouting": (0.1, 0.1), "one_word": (1.0, 0.9)}
    assert [r.name for r in ordered(RULES, figures)][:3] == ["shouting", "one_word", "symbols"]


def test_rules_on_odd_rows(spark):
    docs = odd_documents(spark)
    figures = measure(docs)
    assert set(figures) == {r.name for r in RULES}
    found = quality_rules(docs)
    assert found.columns == ["doc_id", "text", "score", "held_out", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = found.collect()
    assert len(rows) == 8 and not any(r.kept for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[4].n_words == 200_000 and by[4].n_repeat_words == 200_000
    assert by[None].n_words == by[1].n_words == by[2].n_words == 0 and by[6].n_words == 1
    assert quality_rules(docs.limit(0)).count() == 0


def test_rules_are_measured_on_rows_of_the_whole_table(spark):
    """The last rows alone break a rule: a sample of the first ones would not see it."""
    good = " ".join(f"word{k}" for k in range(40))
    docs = spark.range(4000).selectExpr("id AS doc_id", f"IF(id < 3000, '{good}', upper('{good}')) AS text").repartition(4, "doc_id").sortWithinPartitions("doc_id")
    share = measure(docs, rows=400)["shouting"][1]
    assert 0.15 < share < 0.35
    assert measure(docs.limit(0)) == {}


def test_verdict_does_not_depend_on_the_order(spark):
    good = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, good), (2, good.upper()), (3, "a# " * 3 + good + " #" * 20)], "doc_id long, text string")
    for rules in (RULES, RULES[::-1]):
        assert {r.doc_id for r in quality_rules(docs, rules).filter("kept").collect()} == {1}


def test_flat_trees_equal_a_walk_from_the_root():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 5))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    model = fit(rows, labels, rounds=20, depth=3)
    assert ((model.score(rows) > 0.5) == labels).mean() > 0.95
    for row, score in zip(rows[:50], model.score(rows[:50])):
        margin = model.start
        for t in range(20):
            node = 0
            while node < model.feature.shape[1]:
                k = model.feature[t, node]
                node = 2 * node + 1 + int(np.searchsorted(model.edges[k], row[k]) > model.cut[t, node])
            margin += model.leaf[t, node - model.feature.shape[1]]
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_statistics_of_empty_text():
    assert statistics(b" \n") == [0.0] * len(STATISTICS)


def test_classifier_on_odd_rows(spark):
    docs = odd_documents(spark)
    empty = spark.createDataFrame([], LABELS)
    untaught = quality_classifier(docs, empty).collect()
    assert len(untaught) == 8 and {r.score for r in untaught} == {0.5}
    labels = spark.createDataFrame([(4, 0, 0), (4, 0, None), (5, 1, 0), (None, 1, 1), (3, None, 1), (77, 1, 1)], LABELS)
    rows = quality_classifier(docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert quality_classifier(docs.limit(0), labels).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for scored, label, least in ((quality_classifier(docs, labels), "quality", 0.95), (tox.toxicity(docs, labels), "toxic", 0.9)):
        rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
        assert np.mean([r[0] == r[1] for r in rows]) >= least


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    first, second = (sorted(map(tuple, quality_classifier(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert first == second


@pytest.mark.parametrize("text", ["idiot", "you IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "an idi0t.", "(idiot)"])
def test_folding_finds_disguised_terms(text):
    fold = tox.Folder()
    lexicon = tox.Lexicon({fold("idiot"): 2.0}, ())
    assert [m[2] for m in lexicon.matches(text, fold)] == [2.0]


def test_boundaries_and_exceptions():
    fold = tox.Folder()
    lexicon = tox.Lexicon({fold("trash"): 2.0, fold("lowei") + "*": 1.0}, (fold("trash can"),))
    assert lexicon.matches("trashy x trash9 atrash", fold) == []
    assert lexicon.matches("the trash can is full", fold) == []
    assert len(lexicon.matches("trash candy, trash can, trash", fold)) == 2
    assert [m[2] for m in lexicon.matches("loweistra lowei slowei", fold)] == [1.0]
    assert lexicon.normalised("", fold) == 0.0
    long, short = lexicon.normalised("trash " + "x " * 5000, fold), lexicon.normalised("trash", fold)
    assert 0 < long < short


def test_copies_are_one_family():
    words = [f"w{k}" for k in range(60)]
    texts = {k: words[:k] + [f"edit{k}"] + words[k + 1:] for k in range(30)} | {99: [f"other{k}" for k in range(60)]}
    families = tox._families({k: tox._sketch(w) for k, w in texts.items()})
    assert len(set(families.values())) <= 6 and families[99] == 99


def test_toxicity_on_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 1), (5, 1, None), (None, 1, 1), (3, None, 1)], LABELS)
    rows = tox.toxicity(docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert tox.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(600):
        text = rng.choices(words, k=60)
        if k % 6 == 0:
            text[rng.randrange(60)] = "grumbolt"
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(k % 6 == 0)))
    rows += [(10_000, "a gruмb0lt here"), (10_001, "w1 w2 w3")]
    scored = tox.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)).collect()
    by = {r.doc_id: r.predicted for r in scored}
    assert all(by[k] == t for k, _, t in labels) and by[10_000] == 1 and by[10_001] == 0


def test_held_out_is_the_remainder(spark):
    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def plain_matches(lexicon, text, fold):
    """Every term at every place, one by one."""
    plain = fold.lower(text)
    folded = plain.translate(fold.table)
    found, spared = {}, []
    for first in range(len(folded)):
        if first and plain[first - 1].isalnum():
            continue
        for phrase in lexicon.exceptions:
            end = first + len(phrase)
            if folded.startswith(phrase, first) and not (end < len(plain) and plain[end].isalnum()):
                spared.append((first, end))
        for term in {t.rstrip("*") for t in lexicon.weights} - set(lexicon.exceptions):
            end = first + len(term)
            if not folded.startswith(term, first):
                continue
            whole, stem = lexicon.weights.get(term), lexicon.weights.get(term + "*")
            weight = stem if end < len(plain) and plain[end].isalnum() else whole
            if weight is not None and weight > found.get(first, (0, 0, 0.0))[2]:
                found[first] = (first, end, weight)
    return sorted(m for m in found.values() if not any(a <= m[0] and m[1] <= b for a, b in spared))


def test_matches_against_a_plain_scan():
    dice, fold = random.Random(8), tox.Folder()
    lexicon = tox.Lexicon({"trash": 2.0, "trash*": 1.5, "idiot*": 3.0, "can": 0.5, "sore": 1.0, "ioser": 2.5, "worthiess*": 2.0, "scum": 1.2}, tuple(fold(p) for p in tox.EXCEPTIONS))
    parts = ["trash", "can", "bin", "tr4sh", "id1ot", "idiotic", "sore", "loser", "l0ser", "worthlessness", "$cum", "scum", "x", " ", " ", " ", ".", "TRASH", "-", "é", "класс"]
    seen = 0
    for _ in range(3_000):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(14)))
        got = sorted(lexicon.matches(text, fold))
        assert got == plain_matches(lexicon, text, fold), text
        seen += bool(got)
    assert seen > 1_000


def test_a_megabyte_of_exceptions_takes_a_moment():
    fold = tox.Folder()
    lexicon = tox.Lexicon({"trash": 2.0, "idiot": 2.0}, tuple(fold(p) for p in tox.EXCEPTIONS))
    started = time.process_time()
    assert lexicon.matches("trash can " * 100_000, fold) == [] and len(lexicon.matches("trash can trash idiot " * 50_000, fold)) == 100_000
    assert time.process_time() - started < 3


def test_words_that_begin_like_insults_are_clean(spark):
    """The lexicon of the given tables: forms of an insult are found, ordinary words that begin alike are not."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    lexicon, fold = tox.learn(docs.select("doc_id", "text"), labels), tox.Folder()
    clean = ["The pathway through the park is open to visitors today.", "We travelled to Morocco last spring and saw the markets.",
             "The repair was worthwhile and the pathology report was clean.", "This idiom is a disguise for something else.", "Put it into the trash can."]
    assert all(lexicon.score(lexicon.normalised(t, fold)) < 0.3 for t in clean)
    assert all(lexicon.score(lexicon.normalised(t, fold)) >= 0.7 for t in ["You are a pathetic moron.", "What an 1d10t, what a l0ser.", "Pathetic $cum."])


def test_a_beginning_needs_several_words(spark):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 2
        word = ["grumbox", "grumboxes", "grumboxen"][i // 2 % 3] if i % 4 == 1 else "zappername"
        rows.append((f"k{i}", f"{word if toxic else 'zapperot grumbong'} u{i} v{i} w{i} x{i}"))
        labels.append((f"k{i}", None, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id string, quality int, toxic int")
    weights = tox.learn(docs, marks).weights
    assert "grumbox*" in weights and "grumbox" in weights and "zappername" in weights and not any(t.startswith("zapper") and t.endswith("*") for t in weights)
    assert not any(t.startswith("grumb") and t.endswith("*") and len(t) < len("grumbox*") for t in weights)
    for scored in (tox.toxicity(docs, marks), quality_classifier(docs, marks.selectExpr("doc_id", "toxic AS quality", "toxic"))):
        assert scored.count() == 300  # keys need not be numbers
