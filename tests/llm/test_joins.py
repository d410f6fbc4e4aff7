"""N-gram join, Hamming search, connected groups and URL filter against brute force, and on odd rows."""

import random
from itertools import combinations

import numpy as np
import pytest

from haulmark.llm import ngram_join as nj
from haulmark.llm.common import components
from haulmark.llm.hamming import sign_code, top_k
from haulmark.llm.url_filter import canonical, host_of, path_of, url_filter


def plain_components(nodes, edges):
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_join(docs, n, num, den):
    """(doc_id, size, component) by comparing all pairs of the given rows."""
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        k = min(n, len(words))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set())
    edges = [(i, j) for i, j in combinations(range(len(docs)), 2)
             if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    groups = plain_components(range(len(docs)), edges)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[groups[i]] = min(key, least.get(groups[i], key))
    return sorted(((key, len(sets[i]), least.get(groups[i])) for i, (key, _) in enumerate(docs)), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    common = [f"boiler{k}" for k in range(12)]
    for g in range(6):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.choice([8, 30, 90]))]
        for _ in range(rng.choice([2, 5, 25])):
            docs.append(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 4])) + (" " + " ".join(common) if rng.random() < 0.3 else ""))
    docs += [" ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randrange(1, 40))) for _ in range(20)]
    docs += ["", "one", "ONE", "one two", "One\tTWO", "x " * 3000]
    rng.shuffle(docs)
    return [*enumerate(docs), (None, None), (500, None), (None, "only null key"), (3, docs[3]), (3, "another text of key three")]


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 3, 90, 100), (2, 5, 4, 5), (3, 2, 1, 2)])
def test_ngram_join_equals_all_pairs(spark, seed, n, num, den):
    docs = corpus(seed)
    found = nj.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), n, num, den)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_join(docs, n, num, den)


def test_ngram_join_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE_ROWS", 4)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(80)]
    docs = list(enumerate(edited(rng, base[:rng.randrange(60, 80)], rng.randrange(6)) for _ in range(70)))
    found = nj.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 4, 5)
    assert sorted(map(tuple, found.collect()), key=str) == plain_join(docs, 3, 4, 5)


def test_ngram_join_of_nothing_and_of_clashing_columns(spark):
    assert nj.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", 7, 8), (2, "a b c d", 7, 8)], "doc_id long, text string, sid int, component_id int")
    assert sorted(map(tuple, nj.ngram_join(docs).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_bounds_never_miss_a_link():
    rng = random.Random(2)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        bounds = nj.Bounds(num, den)
        for _ in range(3000):
            both, x, y = rng.randrange(1, 60), rng.randrange(8), rng.randrange(8)
            if den * both < num * (both + x + y):
                continue
            order = list(range(both + x + y))
            rng.shuffle(order)
            a, b = sorted(order[:both + x]), sorted(order[:both] + order[both + x:])
            shared = set(a[:bounds.prefix(len(a))]) & set(b[:bounds.prefix(len(b))])
            assert len(shared) >= bounds.least(len(a)) and len(shared) >= bounds.least(len(b))
            assert abs(bounds.band(len(a)) - bounds.band(len(b))) <= 1


def test_product_links_in_strips():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(25)]
    bounds = nj.Bounds(1, 2)
    sides = np.full(25, 2)
    plain = [(i, j) for i, j in combinations(range(25), 2) if 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))]
    forest = nj.product_links(sets, sides, bounds, columns=7)
    assert set(forest) <= set(plain)
    assert plain_components(range(25), forest) == plain_components(range(25), plain)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    plain = plain_components({n for e in edges for n in e}, edges)
    assert found == {n: r for n, r in plain.items() if n in found} and {n for e in edges if e[0] != e[1] for n in e} == set(found)
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_hamming_equals_all_distances(spark):
    rng = random.Random(9)
    centre = [rng.getrandbits(16) for _ in range(4)]
    codes = [(k, rng.choice(centre) ^ (1 << rng.randrange(16)) if k % 3 else centre[0]) for k in range(120)]
    rows = [*codes, (None, 5), (300, None), (0, codes[0][1])]
    queries = [(k, c) for k, c in codes if k % 10 == 0] + [(900, 0), (901, None), (None, 3)]
    found = top_k(spark.createDataFrame(rows, "id long, code long"), spark.createDataFrame(queries, "qid long, code long"), 7, 4, 16)
    plain = [(q, rank + 1, i, d) for q, c in queries if q is not None and c is not None
             for rank, (d, i) in enumerate(sorted(((c ^ x).bit_count(), i) for i, x in codes)[:7])]
    assert sorted(map(tuple, found.collect())) == sorted(plain)


def test_hamming_with_few_rows_and_sign_codes(spark):
    vectors = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, None), (3, [None, 1.0, -1.0]), (4, [])], "id long, v array<float>")
    codes = vectors.select("id", sign_code(vectors.v, 64).alias("code"))
    assert {r.id: r.code for r in codes.collect()} == {1: 5, 2: None, 3: 2, 4: 0}
    found = top_k(codes, codes.withColumnRenamed("id", "qid").filter("qid = 1"), 5)
    assert [(r.id, r.distance) for r in found.orderBy("rank").collect()] == [(1, 0), (4, 2), (3, 3)]
    assert top_k(codes.limit(0), codes.withColumnRenamed("id", "qid"), 5).count() == 0


URLS = [
    "http://WWW.Example.ORG/es/1?x=1#f", "https://sub.example.org/en/12", "http://other.org", "http://a.com/de/", "http://bad.net/x/?utm_source=a&b=2&a=1",
    "https://bad.net:443/x?a=1&b=2&ref=q", "http://bad.net/x?a=1", "nothing", "", None, "x://?q", "http://bad.net/x?a=1&b=2", "http://notexample.org/es/",
]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/")]


@pytest.mark.parametrize("blocks", [1, 64])
def test_url_filter_rules_and_list(spark, blocks):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("verdict", host_of("url"))
    listed = spark.createDataFrame([("http://bad.net/x?b=2&a=1",), ("http://bad.net/x?b=2&a=1",), (None,), ("nothing",)], "url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, RULES, listed, blocks).collect()}
    assert found[0] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert found[1] == ("sub.example.org", "/en/12", "org/", "allow")
    assert found[2] == ("other.org", "", None, "allow")
    assert found[3] == ("a.com", "/de/", "com/de/", "block")
    assert found[12] == ("notexample.org", "/es/", "org/", "allow")
    assert [found[k][3] for k in (4, 5, 6, 11)] == ["block", "block", "allow", "block"]
    assert all(found[k] == ("", "", None, "allow") for k in (7, 8, 9, 10)) and len(found) == len(URLS)


def test_url_filter_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filter(pages, RULES, pages.limit(0)).collect()] == ["allow"]
    assert url_filter(pages.limit(0), RULES, pages).count() == 0


def test_canonical_forms(spark):
    row = spark.range(1).select(*[canonical(u).alias(f"c{k}") for k, u in enumerate(map(_lit, ["HTTP://WWW.A.net:80//?utm_x=1", "ftp://a.net/b/?z&y=1"]))]).first()
    assert tuple(row) == ("a.net", "a.net/b?y=1&z")


def _lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_host_and_path_take_the_first_mark(spark):
    row = spark.range(1).select(host_of(_lit("a\n://H:1/p://q?r")).alias("h"), path_of(_lit("a\n://H:1/p://q?r")).alias("p")).first()
    assert tuple(row) == ("h:1", "/p://q")
