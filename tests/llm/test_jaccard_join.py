"""The n-gram Jaccard join against a brute-force version on all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loregraph.llm.jaccard_join import jaccard_components, packs_of

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width=5):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, set_key string, component long")
    return sorted(map(tuple, jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()))


def near_copies(rng, base, count, share):
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, max(1, int(len(words) * share)))):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def test_groups_chains_and_edges(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One two", "one  TWO", "one two three", "É a b c d", "é a b c d", "a b c d e", "A b\x0bc d e"]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        for share in (0.01, 0.02, 0.04):
            texts += near_copies(rng, base, 12, share)
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[i : i + 120]) for i in range(0, 200, 10)]  # each links with its neighbours only
    texts += [" ".join(f"x{rng.random()}" for _ in range(50)) for _ in range(20)]
    texts += [" ".join(["the same passage of many words over and over"] * 9 + [f"y{rng.random()}"]) for _ in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, start=7))
    assert run(spark, rows) == brute(rows)


def test_very_long_text_and_repeats(spark):
    words = [f"w{i % 70_001}" for i in range(160_000)]
    long = " ".join(words)
    other = " ".join(["q", *words, "r"])
    rows = [(4, long), (9, other), (2, "x" * 3_000_000), (3, "x" * 3_000_000 + " y"), (11, long)]
    found = run(spark, rows)
    assert [r[2] for r in found] == [2, 3, 4, 4, 4]
    assert found[2][1] == len(shingles(long))


def test_many_components_under_one_passage(spark):
    """Sets that share a passage link only within their own small groups."""
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(i, f"{passage} " + " ".join(f"g{i // 2}x{k}" for k in range(22 + i % 7)) + (" end" if i % 2 else "")) for i in range(5000)]
    found = run(spark, rows)
    assert len(found) == 5000
    assert all(component in (doc, doc - 1) for doc, _, component in found)
    assert sum(component < doc for doc, _, component in found) > 2000


def test_a_line_of_all_documents_is_dealt_once_a_packet(spark):
    line = "one line that all of the many documents have"
    texts = [f"{line} " + " ".join(f"u{i}x{k}" for k in range(6)) for i in range(20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    packs = packs_of(docs, 5, 16)
    size = sum(F.coalesce(F.length(c), F.lit(0)) for c, kind in packs.dtypes if kind == "binary" and c not in ("ids", "has_id", "keys", "sizes", "stay"))
    by_range = sorted(r["bytes"] for r in packs.groupBy("range").agg(F.sum(size).alias("bytes")).collect())
    assert packs.where("stay is not null").select("range").distinct().count() == packs.where("stay is not null").count()
    assert by_range[-1] <= 2 * by_range[len(by_range) // 2]


def test_empty_table_and_null_ids(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    found = jaccard_components(docs).collect()
    assert sorted((r[0] is None, r[1], r[2]) for r in found if r[1]) == [(False, 2, 5), (True, 2, 5)]
    assert [(r[0], r[2]) for r in found if not r[1]] == [(None, None)]


@pytest.mark.parametrize("sf", ["0.001"])
def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)
