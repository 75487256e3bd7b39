"""Filter interactions against orders applied one after the other, and against the SQL."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from loregraph.llm import filter_audit as fa

SCHEMA = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(doc, text, least):
    words = WORD.findall(text)
    capitals = len(re.findall("[A-Z]", text))
    found = {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and least.get(text) is not None and doc > least[text],
    }
    return {k for k, v in found.items() if v}


def brute(docs, labels):
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = [(lang or "", fails(doc, text or "", least), doc in good, doc in toxic) for doc, text, lang in docs]
    found = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        sums = Counter()
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                steps.append((part, order, step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        found += [(*s, sums[s[1][s[2] - 1]]) for s in steps]
    return sorted(found)


def rows_of(rng, count):
    texts = []
    for _ in range(count):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 99, 100, 101, 300]))]
        if rng.random() < 0.3:
            words = words[:20] * (len(words) // 20 + 1)
        if rng.random() < 0.3:
            words = [w.upper() + "ABC" for w in words]
        if rng.random() < 0.3:
            words[0] += rng.choice("#$%&*|")
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += rng.choices(texts, k=count // 2) + [None, "", "\x1c \x85", None]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["en", "fr", None, ""])) for i, t in enumerate(texts)]


def run(spark, docs, labels):
    return sorted(map(tuple, fa.filter_audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()))


def test_orders_one_after_the_other(spark):
    rng = random.Random(4)
    docs = rows_of(rng, 60)
    labels = [(rng.randrange(100), rng.choice([0, 1, None]), rng.randrange(2)) for _ in range(80)] + [(None, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


@pytest.mark.parametrize("seed", range(3))
def test_gray_states_equal_plain_sums(seed):
    rng = random.Random(seed)
    cells = {m: (rng.randrange(50), rng.randrange(9), rng.randrange(9)) for m in rng.sample(range(32), rng.choice([1, 7, 32]))}
    for active, state in enumerate(fa.gray_states(cells)):
        assert state == tuple(sum(c[i] for m, c in cells.items() if not m & active) for i in range(3))


def test_shapley_sums_to_all_removed():
    cells = {0: (5, 0, 0), 3: (7, 0, 0), 31: (2, 0, 0), 16: (1, 0, 0)}
    rows = list(fa.audit_rows("x", cells))
    assert sum({r[1][r[2] - 1]: r[-1] for r in rows}.values()) == 120 * 10


def test_odd_rows(spark):
    long = "word " * 200_000
    docs = [(1, None, None), (1, "", None), (2, "", "en"), (None, "", "en"), (None, None, None), (3, long, "en"), (4, long, "fr"), (4, long, "fr"), (5, "A" * 300_000, "en")]
    labels = [(1, 1, 0), (1, 0, 1), (4, None, 1), (9, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)
    clashing = spark.createDataFrame(docs, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("part", "h1", "words", "mask", "least", "good", "toxic", "Bits", "quality")])
    marks = spark.createDataFrame(labels, LABELS).select("*", F.lit(1).alias("mask"), F.lit(2).alias("good"))
    assert sorted(map(tuple, fa.filter_audit(clashing, marks).collect())) == brute(docs, labels)
    assert fa.filter_audit(clashing.limit(0), marks).collect() == []


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    wanted = con.execute(fa.OP12_SQL)
    names = [c[0] for c in wanted.description]
    found = fa.op12_filter_audit(spark, folder)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(wanted.fetchall())
