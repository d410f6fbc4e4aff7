"""Packing and mixing against plain re-counting, and on odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from haulmark.llm.mixing import balanced, fly, land, mix, targets
from haulmark.llm.packing import Packer, Piece, WordTokenizer, pack
from haulmark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_tokenizer_equals_whole_texts(encode):
    import pyarrow as pa

    rng = random.Random(3)
    pool = [*"aBz1.,' \n\téÀ<|>ΣİſK!#-", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "word", "Word.", "end, ", ". ", ",\n", "　", "\x85"]
    texts = ["", None, " ", "\n", "a.", "It's a b., c.\n", *("".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(3000))]
    words = WordTokenizer(tokenizer_path())
    array = pa.array(["padding", *texts]).slice(1)
    for text, ids in zip(texts, words(array)):
        assert ids.tolist() == encode(text), text


def reassembled(rows):
    """Checks the shape of the sequences; the pieces by document key."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    return pieces


def test_every_id_lies_in_one_piece(spark, encode):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 40, 900]))) for _ in range(60)]
    rows = [*enumerate(texts), (None, None), (70, ""), (71, "long word " * 5000), (72, "a<|endoftext|>b")]
    found = pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path())
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = reassembled(found.collect())
    for key, text in rows:
        ids = np.array([*encode(text), 1], "<u4")
        at = 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_of_nothing_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame([("k", "a b", 5, 6), ("k", "a b", 5, 6)], "doc_id string, text string, start int, length int")
    found = pack(rows, tokenizer_path())
    assert sum(r.length for r in found.collect()) == 6 and dict(found.dtypes)["doc_id"] == "string"
    assert pack(rows.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize(("segments", "loss", "prompt"), [(128, None, 0), (3, None, 0), (128, 40, 0), (5, 30, 20)])
def test_packer_keeps_all_limits(segments, loss, prompt):
    rng = random.Random(segments)
    packer = Packer(64, segments, loss, window=16)
    done, docs = [], [rng.choice([1, 2, 7, 30, 63, 64, 65, 300]) for _ in range(300)]
    for k, n in enumerate(docs):
        done += packer.add(Piece(k, np.arange(n, dtype=np.uint32), 0, n, prompt))
    done += packer.finish()
    parts = defaultdict(list)
    for sequence in done:
        total = sum(len(p.ids) for p in sequence)
        assert 0 < total <= 64 and (total == 64 or total & (total - 1) == 0) and len(sequence) <= segments
        assert sum(p.loss() for p in sequence) <= (63 if loss is None else loss)
        for p in sequence:
            parts[p.doc].append(p)
    for k, n in enumerate(docs):
        assert np.concatenate([p.ids for p in sorted(parts[k], key=lambda p: p.start)]).tolist() == list(range(n))
    if segments == 128 and loss is None:  # only the last few sequences may be short
        assert sum(sum(len(p.ids) for p in s) < 64 for s in done) <= 6


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    sizes = [float(rng.randrange(1, 400)) for _ in range(500)]
    counts = [float(rng.choice([1, 1, 1, 3])) for _ in range(500)]
    chances = [rng.random() for _ in range(500)]
    flown = fly(sizes, counts, chances, list(range(500)))
    assert sum(0 < p < 1 for p in flown) <= 2
    assert sum(s * p for s, p in zip(sizes, flown)) == pytest.approx(sum(s * p for s, p in zip(sizes, chances)))
    assert sum(s * p for s, p in zip(counts, flown)) == pytest.approx(sum(s * p for s, p in zip(counts, chances)))
    wanted = sum(s * p for s, p in zip(sizes, chances))
    landed = land(sizes, counts, flown, wanted)
    assert set(landed) <= {0.0, 1.0} and abs(sum(s * p for s, p in zip(sizes, landed)) - wanted) < 2


def test_flight_of_equal_sizes_and_of_nothing():
    flown = fly([5.0] * 10, [1.0] * 10, [0.35] * 10, list(range(10)))
    assert sum(flown) == pytest.approx(3.5) and fly([], [], [], []) == [] and land([], [], [], 0.0) == []


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in held]
        share = (total - sum(held.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if share * weight[s] > most * sizes[s]]
        if not over:
            return held | {s: share * weight[s] for s in rest}
        held |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"big": 10_000, "z": 10, "é": 20, "Z": 30, None: 500}, {"only": 7}, {"none": 0, "some": 5}, {None: 0},
])
def test_targets_equal_plain_sharing(spark, sizes):
    found = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: r.target for r in found.collect()} == pytest.approx(plain_targets(sizes))


def mixed_rows(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a"] * 6 + ["b", "c", None])) for k in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "b"), (None, "x y z", "c"), (7, "twice told", "b"), (7, "twice told", "b"), (8, "w " * 30, "tiny")]
    return spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, size int, copies int")


def test_mix_comes_near_its_targets_and_repeats_itself(spark):
    docs = mixed_rows(spark)
    found = mix(docs, block=64)
    assert sorted(found.columns) == sorted(["doc_id", "text", "source", "size", "source_size", "target", "copies"])
    rows = found.collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 3 and (r.size or not r.copies)
        by[r.source].append(r)
    plain = plain_targets({s: sum(r.size for r in x) for s, x in by.items()})
    for source, x in by.items():
        assert [r.target for r in x] == pytest.approx([plain[source]] * len(x)) and {r.source_size for r in x} == {sum(r.size for r in x)}
        assert abs(sum(r.size * r.copies for r in x) - plain[source]) <= max(60, 0.02 * plain[source])
    again = mix(docs.repartition(7), block=64).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.source or "", r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_of_nothing(spark):
    assert mix(mixed_rows(spark).limit(0)).count() == 0


def test_balanced_takes_blocks_of_one_source(spark):
    units = spark.createDataFrame([(str(k), "s" if k % 2 else None, k % 50 + 1, 1, 0.3) for k in range(600)], "unit string, source string, size long, count long, chance double")
    rows = balanced(units, 32).collect()
    assert sorted(r.unit for r in rows) == sorted(str(k) for k in range(600))
    assert sum(r.chosen for r in rows) == pytest.approx(180, abs=12)


def taken_words(rows):
    words = {}
    for r in rows:
        words[r.source] = words.get(r.source, 0) + r["size"] * r.copies
    return words


@pytest.mark.parametrize("alike", [True, False])
def test_one_key_may_hold_most_rows(spark, alike):
    """A third of the rows under one key or none, of one size: drawn apart, also where they are alike in everything."""
    text = lambda i: " ".join(["w"] * 49 + ["w" if alike else f"x{i}"])
    rows = [(None, text(i), "a") for i in range(1000)] + [(7, text(i), "c") for i in range(1000)]
    rows += [(i, " ".join("v" * (i % 90)), "abc"[i % 3]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix(docs, block=256).collect()
    assert len(found) == len(rows)
    target = {r.source: r.target for r in found}
    assert all(abs(n - target[s]) <= 0.005 * target[s] for s, n in taken_words(found).items())
    rate = {r.source: r.target / r.source_size for r in found}
    hot = [r.copies for r in found if r.doc_id is None]
    assert {int(rate["a"]), int(rate["a"]) + 1} >= set(hot) and abs(sum(hot) / 1000 - rate["a"]) < 0.05
    assert all(r.copies <= 3 and (r.copies == 0 or r["size"]) for r in found)
    again = mix(docs.repartition(5), block=256).collect()
    key = lambda r: (str(r.doc_id), r.text, r.source, r.copies)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_rows_alike_are_written_out_in_runs(spark, monkeypatch):
    monkeypatch.setattr("haulmark.llm.mixing.RUN", 7)
    docs = spark.createDataFrame([(None, "a b", None)] * 40 + [(1, "a b c", "x")] * 30 + [(2, None, "x"), (None, "", None)], "doc_id long, text string, source string")
    found = mix(docs).collect()
    assert len(found) == 72 and len({(r.source, r["size"]) for r in found}) == 4
    target = {r.source: r.target for r in found}
    assert all(abs(n - target[s]) <= 2 for s, n in taken_words(found).items())


def test_the_pipeline_mixes_rows_of_one_key_apart(spark):
    import corpus_pipeline

    rows = [(None, " ".join(["w"] * 49 + [f"x{i}"]), "en", "a", 1) for i in range(1000)] + [(i, "one two three four " * 20, "en", "ab"[i % 2], 1) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r.source: r.target for r in mix(docs).collect()}
    words = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert all(abs(words[s] - t) <= 0.02 * t for s, t in target.items())
