"""Trigram postings against the scan, cells against all vectors, ranks against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregraph.operators import cells as K
from loregraph.operators import rank as P
from loregraph.operators import substring as S
from loregraph.operators.vector import cosine_search
from loregraph.plans import registry
from loregraph.sources import relgraph as R

DIR = "/root/testdata/sf0.001"


def nodes_of(spark, texts):
    rows = [(f"N:{i}", [t[0]] if t[0] is not None else None, {"title": t[1]}, {"list": t[2]} if t[2] else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, aliases array<string>, fields_text map<string,string>, fields_list map<string,array<string>>")


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeÉ ") for _ in range(rng.randint(0, 9)))
    rows = [(rng.choice([None, word()]), word() if rng.random() < 0.9 else None, [word(), word()] if rng.random() < 0.5 else None) for _ in range(400)] + [("x" * 60_000 + "needle", "y", None)]
    folder = f"file://{tmp_path_factory.mktemp('texts')}/t"
    S.write_bucketed(nodes_of(spark, rows), f"{folder}/nodes", "id", 3)
    nodes = S.bucketed_table(spark, f"{folder}/nodes", "id", 3)
    S.write_texts(nodes, f"{folder}/texts", 3, most=60)
    return S.open_texts(spark, f"{folder}/texts", nodes, 3)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("probe", [0, 1000])
def test_postings_find_what_the_scan_finds(spark, texts, monkeypatch, probe):
    monkeypatch.setattr(S, "PROBE", probe)
    for needle in ("abc", "É a", "DEé", "ab", "", "n:1", "a,b", "zzzz", "xneedle", "e e e e"):
        assert ids(texts.search(needle)) == ids(S.text_search(texts.nodes, needle)), needle
        assert ids(texts.search(needle, ["title"])) == ids(S.text_search(texts.nodes, needle, ["title"])), needle
    for words in (["abc", "a"], ["n:2", "bcd"], ["a", "b"], ["abc", "cde"], ["zzz", "abc"]):
        assert ids(texts.search_words(words)) == ids(S.all_words_search(texts.nodes, words)), words


def test_candidates_are_few(texts):
    assert texts.grams.where("slots > 1").count() > 0
    everything = texts.nodes.count()
    found = S.text_search(texts.nodes, "abcd").count()
    assert found <= texts.candidates(["abcd"]).count() <= max(2 * found, everything // 10)
    assert texts.candidates(["ab"]) is None and texts.candidates(["zzz"]).count() == 0


def test_grams_of_texts(spark):
    row = spark.range(1).select(S.grams_of(F.array(F.lit("abcab"), F.lit("ab"), F.lit(""), F.lit("éab c"), F.lit("bca"))).alias("g")).first()
    assert sorted(row["g"]) == sorted({"abc", "bca", "cab", "éab", "ab ", "b c"})


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    root = f"file://{tmp_path_factory.mktemp('cells')}/c"
    K.write_cells(table, root)
    return table, K.open_cells(spark, root)


def test_recall_and_rows_scored(spark, vectors):
    """Of each query's ten nearest, nine of ten at least are found, by exact scores of 40 vectors; the exact search finds all.

    These vectors have no clusters, so six of ten cells are read, as codes.
    """
    table, index = vectors
    data = {r["id"]: r["vector"] for r in table.collect()}
    order = sorted(data)
    unit = K.unit_rows(np.array([data[i] for i in order]))
    probes = round(len(index.ids) * 0.65)
    found = coded = 0
    queries = order[:: max(1, len(order) // 12)]
    for q in queries:
        best = [order[i] for i in np.argsort(-(unit @ unit[order.index(q)]), kind="stable")[:10]]
        got = [r["id"] for r in index.search(data[q], 10, probes).collect()]
        found += len(set(best) & set(got))
        coded += index.coded(index.nearest_cells(data[q], probes))
        assert index.shortlist(data[q], 10 * K.RESCORED, probes).count() == 40
    assert found >= 0.9 * 10 * len(queries)
    assert coded <= 0.7 * len(order) * len(queries)
    for q in queries[:3]:
        exact = index.search_exact(data[q], 10, min_score=-1.0).select("id", "score").collect()
        want = cosine_search(table, data[q], 10, min_score=-1.0).select("id", "score").collect()
        assert [r["id"] for r in exact] == [r["id"] for r in want]


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    """Vectors about 20 directions: a tenth of the cells has nine of ten neighbours, and the exact search leaves most cells out."""
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(20, 16))
    data = np.repeat(heads, 40, 0) + rng.normal(size=(800, 16)) * 0.1
    K.write_cells(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id int, vector array<double>"), f"file://{tmp_path}/c", cells=20)
    index = K.open_cells(spark, f"file://{tmp_path}/c")
    unit = K.unit_rows(data)
    found = 0
    for q in range(0, 800, 100):
        best = set(np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist())
        found += len(best & {r["id"] for r in index.search(data[q].tolist(), 10, 2).collect()})
        least = np.sort(unit @ unit[q])[-10]
        assert len(index.cells_over(data[q].tolist(), least)) <= 4
    assert found >= 0.9 * 80


def test_every_vector_is_stored(spark, vectors):
    table, index = vectors
    assert index.rows.count() == table.count() == int(index.counts.sum())


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.1]), (7, [float("nan"), 1.0]), (8, [None, 1.0])]
    K.write_cells(spark.createDataFrame(rows, "id int, vector array<double>"), f"file://{tmp_path}/c", cells=3)
    index = K.open_cells(spark, f"file://{tmp_path}/c")
    assert [r["id"] for r in index.search_exact([2.0, 0.0], 9, 1, min_score=-1.0).collect()] == [1, 4, 6]
    assert [r["id"] for r in index.search([2.0, 0.0], 9, 1).collect()] == [1, 4]
    assert index.search([0.0, 0.0], 3).collect() == [] and index.search_exact([1.0], 3).collect() == []
    K.write_cells(spark.createDataFrame([], "id int, vector array<double>"), f"file://{tmp_path}/none")
    assert K.open_cells(spark, f"file://{tmp_path}/none").search([1.0], 3).collect() == []


def plain_rank(edges, seeds, damping, weights, both):
    names = sorted({x for a, b, _ in edges for x in (a, b)} | set(seeds))
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, t in edges:
        m[at[a], at[b]] += weights.get(t, 1.0)
        if both:
            m[at[b], at[a]] += weights.get(t, 1.0)
    out = m.sum(axis=1)
    m[out > 0] /= out[out > 0][:, None]
    restart = np.zeros(len(names))
    for n, w in seeds.items():
        restart[at[n]] = w / sum(seeds.values())
    r = restart.copy()
    for _ in range(200):
        moved = damping * (r @ m)
        r = moved + (1 - moved.sum()) * restart
    return {n: r[at[n]] for n in names if r[at[n]] > 0}


@pytest.mark.parametrize("both", [False, True])
def test_rank_against_numpy(spark, both):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(40)}", rng.choice("ABC")) for _ in range(90)]
    seeds = {"n1": 1.0, "n5": 3.0, "alone": 2.0}
    weights = {"A": 2.5, "C": 0.0}
    table = spark.createDataFrame(edges, "from_node string, to_node string, edge_type string")
    start = spark.createDataFrame([("n1", 0.5), ("n1", 0.5), ("n5", 3.0), ("alone", 2.0), (None, 1.0), ("n2", 0.0)], "id string, weight double")
    found, rounds = P.personal_rank(table, start, 0.8, 1e-12, 200, weights, both)
    got = {r["id"]: r["rank"] for r in found.collect()}
    want = plain_rank(edges, seeds, 0.8, weights, both)
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-9 for n in want) and rounds < 200
    assert sum(got.values()) == pytest.approx(1)


def test_rank_without_seeds_or_edges(spark):
    table = spark.createDataFrame([], "from_node string, to_node string, edge_type string")
    seeds = spark.createDataFrame([("a", 1.0)], "id string, weight double")
    assert [tuple(r) for r in P.personal_rank(table, seeds)[0].collect()] == [("a", 1.0)]
    assert P.personal_rank(table, seeds.limit(0))[0].collect() == []


def test_hybrid_over_the_store_equals_the_plain_index(spark):
    from dataclasses import replace

    from loregraph.plans import queries as Q

    stored = R.stored(spark, DIR)
    vector = registry.query_vector(spark, DIR)
    same = [sorted(map(tuple, Q.hybrid_query(registry._named(i), "Brand#1", vector, depth=1, min_score=0.1, limit=40).rows.select("node_id", "match_source").collect())) for i in (stored, replace(R.index(spark, DIR)))]
    assert same[0] == same[1] and same[0]
