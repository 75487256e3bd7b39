"""Files are dealt out before they are made, read once, and rarely need the YAML parser."""

import pytest
from pyspark.sql import functions as F

from loregraph.functions.storage import spread
from loregraph.operators import parse as P
from loregraph.plans import document_registry as D
from loregraph.sources import relmarkdown as R

DIR = "/root/testdata/sf0.001"


def test_a_small_file_of_many_rows_is_several_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    dealt = spread(rows, "id", 100)
    assert rows.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 10
    assert sorted(r["id"] for r in dealt.collect()) == list(range(1000))
    assert spread(rows, "id", 1000) is rows


def test_front_matter_is_read_once(spark):
    """A filter on the kind repeats neither the fields nor the parser."""
    plan = P.parse_documents(R.files(spark, DIR))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan


def test_stored_documents_are_those_parsed(spark):
    files = R.files(spark, DIR)
    for a, b in zip(P.parse_documents(files), P.parse_documents(files, stored=True)):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("block, plain", [
    ("aliases: [Brand#13, STANDARD TIN]", True), ("title: no#1 of b#2", True), ("a:\n  - x#1", True),
    ("a: b #c", False), ("a: [b, #c]", False), ("a: [b,#c]", False), ("a: [#b]", False), ("a:\n  - x #1", False), ("a: [b#, -c]", False), ("a:b#c", False),
])
def test_a_sign_within_a_word_opens_no_comment(spark, block, plain):
    rows = spark.createDataFrame([(f"---\n{block}\n---\nx",)], "content string")
    fields, body = P.front_matter(F.col("content"))
    found = rows.select(P._block(F.col("content"))[2].alias("plain"), F.map_values(F.transform_values(fields, lambda _, v: P.listed(v))).alias("said"), body.alias("body")).first()
    assert found["plain"] == plain
    wanted = P.yaml_fields(block)
    if plain:
        listed = spark.createDataFrame([(v,) for v in wanted.values()], "v string").select(P.listed(F.col("v")).alias("v")).collect()
        assert found["said"] == [r["v"] for r in listed] and found["body"] == "x"


@pytest.mark.parametrize("name", ["index_log", "unknown_mentions", "cascade_delete", "hashed_vectors", "resolve_hints", "find_spec", "context_deep"])
def test_a_query_parses_its_files_once(spark, monkeypatch, name):
    calls = []
    parsed = P.parsed_rows
    monkeypatch.setattr(P, "parsed_rows", lambda files: calls.append(1) or parsed(files))
    found = getattr(D, name)(spark, DIR)
    assert calls == [1]
    assert "ArrowEvalPython [parsed_yaml" not in found._jdf.queryExecution().optimizedPlan().toString()
