"""Near copies of one family, whose exact similarities lie on both sides of the threshold."""

import random

import plain_versions as brute
import pytest

from verdantspark.llm import simhash


def fresh(rng, n):
    return [str(rng.randrange(10**9)) for _ in range(n)]


@pytest.fixture(scope="module")
def family():
    """Documents of one template, of similarity 0.75 by their sets of five-word shingles; 2 i and 2 i + 1 have 0.82."""
    rng = random.Random(8)
    template = fresh(rng, 304)
    texts = []
    for _ in range(150):
        both = fresh(rng, 16)
        texts += [" ".join(template + both + fresh(rng, 34)) for _ in range(2)]
    return texts


def test_family_at_the_threshold(spark, family):
    df = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_copies(df, 5, 0.8).collect()}
    want = {(2 * i + 1, 2 * i) for i in range(150)}
    assert found <= want and len(found) >= 146


def test_equal_fingerprints_of_other_texts(spark):
    """Texts dominated by one repeated passage have equal fingerprints if repeats count, however much else they hold."""
    rng = random.Random(9)
    passage = fresh(rng, 40)
    texts = [" ".join(passage * 60 + fresh(rng, 60)) for _ in range(12)]
    df = spark.createDataFrame([*enumerate([*texts, texts[3]])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_copies(df, 5, 0.8).collect()} == {(12, 3)}


def test_sure_candidates_are_checked(monkeypatch, spark, family):
    """However near the fingerprints, pairs link by their shingles only."""
    monkeypatch.setattr(simhash, "bits_for", lambda *_: 200)
    df = spark.createDataFrame(list(enumerate(family[:80])), "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_copies(df, 5, 0.8).collect()} == {(2 * i + 1, 2 * i) for i in range(40)}


def groups(texts, similarity=0.8):
    """Documents that aren't the first of their group, by comparing all with all."""
    sets = [brute.shingles(t, 5) for t in texts]
    root = list(range(len(sets)))

    def of(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            shared = len(a & b)
            if shared >= similarity * (len(a) + len(b) - shared):
                x, y = of(i), of(j)
                root[max(x, y)] = min(x, y)
    return {(i, of(i)) for i in range(len(sets)) if of(i) != i}


@pytest.fixture(scope="module")
def large_group():
    """900 versions of one text of 220 words with 3 to 6 words edited each: some pairs reach 0.8, most miss it by little."""
    rng = random.Random(17)
    base = fresh(rng, 220)
    texts = []
    for _ in range(900):
        w = list(base)
        for at in rng.sample(range(220), rng.randint(3, 6)):
            w[at] = str(rng.randrange(10**9))
        texts.append(" ".join(w))
    return texts, groups(texts)


@pytest.mark.parametrize("partitions", [1, 13])
def test_large_group(spark, large_group, partitions):
    texts, want = large_group
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {(r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(want) > 300 and found == want


def test_blocks_give_the_same(spark, monkeypatch, large_group):
    """Small blocks of keys and of candidate groups, and the search of long keys, change the tasks only."""
    texts, _ = large_group
    df = spark.createDataFrame(list(enumerate(texts[:300])), "doc_id long, text string")
    want = groups(texts[:300])
    for name, value in (("BLOCK_TEXTS", 40), ("BLOCK_ROWS", 64), ("COMPARED", 5)):
        monkeypatch.setattr(simhash, name, value)
    assert {(r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()} == want


def test_longer_segments(spark, monkeypatch, family):
    monkeypatch.setattr(simhash, "ring_of", lambda _: (4, 16))
    df = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()}
    want = {(2 * i + 1, 2 * i) for i in range(150)}
    assert found <= want and len(found) >= 146


def test_repeated_ids_and_blank_texts(spark):
    base = " ".join(map(str, range(100)))
    rows = [(1, base), (1, "other words here for the same id"), (2, base + " x"), (3, ""), (4, None), (5, " \n"), (None, base), (6, "z"), (6, "z"), (7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()} == {(2, 1), (4, 3), (5, 3), (7, 6)}


def test_candidates_do_not_depend_on_the_number_of_documents(spark, monkeypatch):
    """The same fingerprints and keys for tables of any size."""
    asked = []
    links = simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda classes, per, parts, most: asked.append((per, parts, most)) or links(classes, per, parts, most))
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(fresh(rng, 12))) for i in range(6)], "doc_id long, text string")
    for n in (6, 2_000_000, 20_000_000):
        monkeypatch.setattr(type(df), "count", lambda self, n=n: n)
        simhash.near_copies(df, 5, 0.8)
    assert len(asked) == 3 and len(set(asked)) == 1
