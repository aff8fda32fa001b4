import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

edits = pytest.importorskip("wardline.llm.edits")
from wardline.llm import matching, names, trie, variants  # noqa: E402

SYLLABLES = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후"


def some_words(n, seed, syllables=SYLLABLES):
    r = random.Random(seed)
    cores = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)]
    return sorted({names.romanized(c) if i % 8 == 0 else c for i, c in enumerate(cores)})


def by_columns(forms, left, right):
    words = sorted({*left, *right})
    known, number = edits.Words(words, forms), {w: i for i, w in enumerate(words)}
    a, b = (x.ravel() for x in np.meshgrid([number[w] for w in left], [number[w] for w in right], indexing="ij"))
    at, told = known.near(a, b)
    return {(words[a[i]], words[b[i]]): int(e) for i, e in zip(at, told)}


def test_words_by_columns_equal_traversal():
    for seed in range(3):
        left, right = some_words(120, seed, SYLLABLES[: 6 + 8 * seed]), some_words(120, seed + 50, SYLLABLES[: 6 + 8 * seed])
        for forms in (variants.spellings, variants.wide_spellings):
            assert by_columns(forms, left, right) == trie.near_words(forms, left, right)
    mixed = lambda w: [trie.Form("a", w, 1, 2, len(w) > 3), trie.Form("a", w[::-1], 2, 2, False, 1), trie.Form("b", w[:2], 0, 0)]
    words = ["".join(random.Random(i).choices("ab", k=i % 9 + 1)) for i in range(60)] + ["x" * 63, "x" * 64, "x" * 33 + "y"]
    got = by_columns(mixed, words, words)
    assert {k: v for k, v in got.items() if k[0] != k[1]} == {k: v for k, v in trie.near_words(mixed, words, words).items() if k[0] != k[1]}


def test_names_of_a_town_take_a_fraction_of_their_traversal():
    left, right = some_words(1500, 1), some_words(1000, 2)
    for words in (left, right):
        list(map(variants.spellings, words))
    began = time.thread_time()
    columns = by_columns(variants.spellings, left, right)
    between = time.thread_time()
    assert columns == trie.near_words(variants.spellings, left, right)
    assert 3 * (between - began) < time.thread_time() - between


def test_equal_rows_and_records_are_compared_once(spark, monkeypatch):
    """Each of 12 records under 12 keys and 20 equal rows: one comparison stands for 240, with results as of all of them."""
    schema = "key string, block string, name string, town string, stated string, phone string, addresses array<string>, postal string, lat double, lon double, beds array<int>, size int"
    house = lambda key, i: (key, "b", SYLLABLES[3 * i : 3 * i + 3] + "종합병원", "가람", None, f"081-{200 + i}-1903", [None], None, 35.0 + i, 127.0, None, 100)
    rows = spark.createDataFrame([house(f"r{i:02d}.{k:02d}", i) for i in range(12) for k in range(20)], schema)
    register = spark.createDataFrame([house(f"s{i:02d}.{k:02d}", i) for i in range(12) for k in range(12)], schema)
    seen, links = [], matching.candidate_links
    monkeypatch.setattr(matching, "candidate_links", lambda *a: seen.append(links(*a)) or seen[-1])
    _, candidates = matching.scored(rows, register)
    assert seen[0].count() == 12
    got = {(x.left, x.right) for x in candidates.collect()}
    assert got == {(f"r{i:02d}.00", f"s{i:02d}.{k:02d}") for i in range(12) for k in range(12)}
    assert all(x.n == 1 for x in candidates.groupBy("left").agg(F.countDistinct("log_odds").alias("n")).collect())
