"""SuperMinHash near-duplicates against all pairs, and the signatures against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregraph.llm import super_minhash as sm
from loregraph.llm.shingles import splitmix
from tests.llm.test_jaccard_join import WORDS, near_copies, shingles

U = np.uint64


def brute(rows, percent=85, width=3):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)] if s else doc, doc == (least[find(i)] if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id bigint, text string, set_key string, r1 long, bands int")
    return sorted(map(tuple, sm.near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()))


def plain_signature(elements, slots):
    """One element after the other, each through its whole permutation."""
    best = [int(sm.EMPTY)] * slots
    for e in elements:
        order = list(range(slots))
        for j in range(slots):
            drawn = int(splitmix(np.array([e], U) ^ splitmix(np.array([j + 1], U)))[0])
            k = j + ((drawn >> 40) * (slots - j) >> 24)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], j << sm.RANK_BITS | drawn & (1 << sm.RANK_BITS) - 1)
    return best


def test_early_stop_changes_no_signature():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 0, 2, 7, 60, 400])
    hashes = rng.integers(0, 1 << 63, int(sizes.sum())).astype(U)
    found = sm.signatures(hashes, sizes, 24)
    for i, at in enumerate(np.cumsum(sizes) - sizes):
        assert found[i].tolist() == plain_signature(hashes[at : at + sizes[i]], 24)


def test_chunks_change_no_signature(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = np.array([500, 3, 900])
    hashes = rng.integers(0, 1 << 63, int(sizes.sum())).astype(U)
    whole = sm.signatures(hashes, sizes)
    monkeypatch.setattr(sm, "CHUNK", 37)
    assert (sm.signatures(hashes, sizes) == whole).all()


@pytest.mark.parametrize("share", [0.5, 0.85, 0.95])
def test_agreement_estimates_similarity(share):
    """Mean at the similarity; the spread at most that of independent hashes."""
    rng = np.random.default_rng(int(share * 100))
    found = []
    for _ in range(150):
        n = 40
        both = rng.integers(0, 1 << 63, 2 * n).astype(U)
        common = round(2 * n * share / (1 + share))
        a, b = both[:n], both[n - common : 2 * n - common]
        found.append((sm.signatures(np.concatenate([a, b]), np.array([n, n])), common / (2 * n - common)))
    agree = np.array([(s[0] == s[1]).mean() - j for s, j in found])
    j = found[0][1]
    assert abs(agree.mean()) < 4 * (j * (1 - j) / sm.SLOTS / len(agree)) ** 0.5
    assert agree.var() < 1.1 * j * (1 - j) / sm.SLOTS


def test_groups_chains_and_edges(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One two", "one  TWO", "one", "One", "É a b c d", "é a b c d", "a b c d e", "A b\x0bc d e"]
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(10, 200))]
        for share in (0.01, 0.03, 0.06):
            texts += near_copies(rng, base, 10, share)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_pairs_at_the_threshold(spark):
    """Sets of 37 and 37 with 34 in common are at 85 %, with 33 below."""
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(39)]
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(words[:36] + ["x", "y", "z"])), (3 * g + 2, " ".join(words[:35] + ["p", "q", "r", "s"]))]
    assert run(spark, rows) == brute(rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = sm.op13_super_minhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == brute(rows)


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = list(enumerate(near_copies(rng, base, 1500, 0.02)))
    made = []
    from loregraph.llm import jaccard_join

    plain = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: made.append(pairs.count()) or plain(pairs, *a))
    assert {c for _, _, c, _ in run(spark, rows)} == {0}
    assert sum(made) < 4 * len(rows)


def test_odd_rows(spark):
    long = "a long text of words " * 20_000
    rows = [(1, "one two three four"), (1, "one two three four"), (2, None), (None, ""), (None, "no id here"), (None, "no id here"), (3, long), (4, long), (5, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(1).alias(c) for c in ("n", "bits", "R2", "token", "p", "component", "kept", "weight")])
    found = sorted(map(tuple, sm.near_groups(docs).collect()), key=repr)
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 5, 3, True), (4, 5, 3, False), (5, 1, 5, True), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True)]
    assert found == sorted(want, key=repr)
    assert sm.near_groups(docs.limit(0)).collect() == []


def test_union_find_keeps_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    df = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in links], "a binary, b binary").repartition(3)
    parts = lambda pairs: {frozenset(g) for g in grouped(pairs)}
    forest = [(bytes(r["a"]), bytes(r["b"])) for r in sm.spanning_forest(df).collect()]
    assert parts(forest) == parts([(b"%03d" % a, b"%03d" % b) for a, b in links if a != b])
    assert len(forest) <= 3 * 300


def grouped(pairs):
    groups = {}
    for a, b in pairs:
        both = groups.get(a, {a}) | groups.get(b, {b})
        for x in both:
            groups[x] = both
    return groups.values()


def test_words_are_those_of_the_contract():
    assert WORDS.findall("a\x1cb \x85c\x0bd") == ["a\x1cb", "\x85c", "d"]


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(8)
    for n, d in ((3, 1), (200, 30), (900, 150)):
        pool = rng.integers(0, 1 << 63, n + d).astype(U)
        a, b = sm.odd_sketches(np.concatenate([pool[:n], pool[d:]]), np.array([n, n])).view(U)
        assert 0 < sum(int(x).bit_count() for x in a ^ b) <= 2 * d
