"""Mixing against its SQL twin, and its totals on small cases."""

from collections import defaultdict

import duckdb
import pytest

from loregraph.llm.mixing import OP4_SQL, mix, mixed_rows, op4_mixing, word_count


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({OP4_SQL})").fetchall())
    assert sorted(map(tuple, op4_mixing(spark, "/root/testdata/sf0.001").collect())) == want


def test_targets_and_limits(spark):
    rows = [(i, "w " * (i % 7), s, len("w " * (i % 7))) for i, s in enumerate(["b"] * 40 + ["a"] * 3 + [None] * 9 + ["c"] * 100)]
    rows += [(500, None, "d", 0), (501, "", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    found = mix(docs).collect()
    assert len(found) == len(rows)
    total = sum(r["size"] for r in found)
    by, target = defaultdict(int), {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["target"] <= 3 * r["source_size"]
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(by[s] - target[s]) <= 0.5 for s in by)
    assert {tuple(r) for r in mix(docs).collect()} == {tuple(r) for r in found}
    taken = mixed_rows(docs)
    assert taken.columns == docs.columns
    words = defaultdict(int)
    for r in taken.select("source", word_count("text").alias("n")).collect():
        words[r["source"]] += r["n"]
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in by.items() if n}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string, taken int")
    assert mix(docs).collect() == []
    assert mixed_rows(docs).collect() == []


def test_rows_of_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else 7, "w " * (1 + i % 9) + f"t{i}", "ab"[i % 3 > 0], "x") for i in range(120)]
    rows += [(9, "one two three", s, "x") for s in "aabbbbbb"] + [(9, "one two three", "b", "y"), (None, "null source", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    want, found = defaultdict(int), defaultdict(int)
    for r in mix(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["taken"]
    taken = mixed_rows(docs).select("doc_id", "source", "text", word_count("text").alias("n")).collect()
    whole = {(d, s, t): len(t.split()) for d, t, s, _ in rows}
    starts = {}
    for r in taken:  # each is a row, or the one at its source's cut
        key = (r["doc_id"], r["source"], r["text"])
        if key not in whole:
            assert starts.setdefault(r["source"], key) == key
        found[r["source"]] += r["n"]
    by = defaultdict(int)
    for (_, s, _), n in want.items():
        by[s] += n
    assert found == by
    assert len(taken) > len(rows) // 2 and sorted(map(str, taken)) == sorted(map(str, mixed_rows(docs.repartition(3)).select("doc_id", "source", "text", word_count("text").alias("n")).collect()))
