"""The filter audit against counts made order by order, and the potential against averages over orders."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from haulmark.llm.filter_audit import failure_counts, filter_audit, interaction_audit, potentials, words_of

DOCS = "doc_id long, text string, lang string, mask string, n long"
LABELS = "doc_id long, quality int, toxic int, part string, n int"


def brute_force(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        words = t.encode().split()
        fails = {f for f, bad in zip("ABCDE", [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and least[t] < i]) if bad}
        own = [x for x in labels if x[0] is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    found = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in found.items():
            if p == part:
                values.append(sums[order[step - 1]])
    return found


def result(spark, docs, labels):
    rows = filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_against_every_order(spark):
    dice = random.Random(5)
    texts = [None, "", " \t\n", "one # two", "ALL CAPS HERE", " ".join(f"w{i}" for i in range(120)), "same word " * 80,
             " ".join(f"Ü{i}" for i in range(130)), " ".join(f"X{i} &" for i in range(60))]
    docs = [(dice.choice([None, *range(30)]), dice.choice(texts), dice.choice(["en", "de", "", None]), "x", 7) for _ in range(150)]
    docs += docs[:20]  # whole rows again
    labels = [(dice.choice([None, *range(30)]), dice.choice([0, 1, None]), dice.choice([0, 1, None]), "p", 3) for _ in range(40)]
    assert result(spark, docs, labels) == brute_force(docs, labels)


def test_one_text_and_one_key_hold_most_rows(spark):
    docs = [(i, "copied text", "en", "x", 1) for i in range(300)] + [(7, f"text {i}", "en", "x", 1) for i in range(200)] + \
           [(None, "copied text", "fr", "x", 1)] * 50
    labels = [(7, 1, 1, "p", 1), (7, 0, 0, "p", 1), (9, 1, 0, "p", 1)]
    assert result(spark, docs, labels) == brute_force(docs, labels)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit(none, labels).count() == 0
    assert filter_audit(spark.createDataFrame([(1, "a", "en", "x", 1)], DOCS), labels).count() == 600


def test_other_sets_of_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 0), ("p", 3, 4, 0, 2), ("p", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in interaction_audit(counts, "xy").collect()}
    assert len(rows) == 4 and rows["xy", 1].removed == 8 and rows["xy", 2].removed == 0 and rows["xy", 2].redundant == 5
    assert rows["yx", 1].removed == 5 and rows["yx", 2].removed == 3 and rows["yx", 2].unique_fails == 3
    assert rows["xy", 1].shapley == 11 and rows["xy", 2].shapley == 5 and rows["yx", 2].kept == 5


def test_potentials_of_a_game(spark):
    worths = [0, 2, 3, 9]  # of no filter, the first, the second, both
    row = spark.range(1).select(potentials(F.array(*[F.lit(w).cast("long") for w in worths]), 2).alias("p")).first()
    assert list(row.p) == [0, 4, 6, 14]  # twice 0, 2, 3 and (9 + 2 + 3) / 2


@pytest.mark.parametrize("window", [1, 2, 3, 7, 64])
def test_words_of_long_texts(window):
    dice = random.Random(window)
    for _ in range(200):
        text = "".join(dice.choice(["a", "b", "é", " ", "\n", "\x0b"]) for _ in range(dice.randrange(40))).encode()
        words = text.split()
        assert words_of(text, window) == (len(words), len(set(words)))


def test_a_very_long_text(spark):
    docs = [(1, "word " * 1_000_000 + "x" * 3_000_000, "en", "x", 1), (2, "a" * 5_000_000, "en", "x", 1)]
    rows = failure_counts(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).filter("n > 0").collect()
    assert {(r["mask"], r["n"]) for r in rows} == {(2, 1), (1, 1)}
