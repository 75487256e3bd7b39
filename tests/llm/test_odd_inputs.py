"""The same odd rows through every operator: nulls, empty and very long texts, repeats, clashing names, empty tables."""


import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loregraph.llm import bpe, common, fingerprints, jaccard_join, language_id, mixing, quality, token_files, topk_search
from loregraph.llm.common import shard_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "a long text of words " * 20_000
ROWS = [(1, "one two three", "en", "s"), (1, "one two three", "en", "s"), (2, None, None, None), (None, "", "en", "s"), (None, "no id here", "fr", None), (3, LONG, "en", "t"), (4, "\x00 \u2003 \ud7ff é", "fr", "t"), (5, " \n\t ", "en", "s")]
#: Names that the operators use inside, or that they give.
NAMES = ["__id", "__text", "__row", "__size", "__words", "__score", "text_", "d", "row", "size", "words", "at", "cut", "rest", "key", "part", "id", "label", "score", "Score", "lang_pred", "fingerprint", "n_tokens", "shard", "place", "term", "token", "component", "set_key"]


def odd(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    taken = {"score"}
    return docs.select("*", *[F.lit(f"v{i}").alias(n) for i, n in enumerate(NAMES) if not (n.lower() in taken and n != "score")])


def model(spark):
    rows = [(i, f"the cat and the dog {i} were there", "en") if i % 2 else (i, f"le chat et le chien {i} etaient la", "fr") for i in range(80)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def good(spark):
    docs = spark.createDataFrame([(i, (f"A calm sentence about item {i} and its uses. " if i % 2 else f"$$ CLICK {i} WIN !!! ") * 6) for i in range(200)], "doc_id bigint, text string")
    return quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))


def run(spark, name, docs):
    if name == "tokens":
        return token_files.write_token_files(docs, PATH, 0).checksums()
    if name == "jaccard":
        return jaccard_join.jaccard_components(docs)
    if name == "mix":
        return mixing.mix(docs)
    if name == "fingerprints":
        return fingerprints.edited_fingerprints(docs)
    if name == "fingerprint":
        return fingerprints.fingerprint(docs)
    if name == "bpe":
        return bpe.encode_digests(docs, PATH)
    if name == "texts":
        return bpe.encode_texts(docs, PATH)
    if name == "language":
        return language_id.identify(docs, language_id.fit(model(spark)))
    return quality.score(docs, good(spark))


ALL = ["tokens", "jaccard", "mix", "fingerprints", "fingerprint", "bpe", "texts", "language", "quality"]


@pytest.mark.parametrize("name", ALL)
def test_every_row_gives_one(spark, name):
    found = run(spark, name, odd(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in found) == [0, 0, 1, 1, 2, 3, 4, 5]
    kept = set(NAMES) & set(found[0].asDict())
    if name in ("fingerprint", "bpe", "texts", "language", "quality"):  # these keep other columns, with their values
        assert {"__id", "__text", "row", "d", "set_key"} <= kept and found[0]["__text"] == "v1"
    twice = [r for r in found if r["doc_id"] == 1]
    same = [c for c in twice[0].asDict() if c not in ("start", "shard", "taken", "epochs", "near_next", "near_edited", "edited_fingerprint", "edited_sha256")]
    assert all(twice[0][c] == twice[1][c] for c in same)


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    docs = odd(spark).limit(0)
    assert run(spark, name, docs).collect() == []


def test_search_with_odd_rows(spark):
    found = topk_search.top_k(odd(spark), odd(spark).where("doc_id = 1 OR doc_id IS NULL"), 3).collect()
    assert {(r["query"], r["rank"], r["doc_id"]) for r in found} == {(1, 1, 1), (1, 2, 1), (None, 1, None)}


def test_defined_results(spark):
    docs = odd(spark)
    by = {(r["doc_id"], r["text"]): r for r in run(spark, "language", docs).collect()}
    assert by[2, None]["lang_pred"] == by[5, " \n\t "]["lang_pred"] == "und"
    scores = {r["doc_id"]: r["score"] for r in run(spark, "quality", docs).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[2] == [r["score"] for r in run(spark, "quality", docs.where("text = ''")).collect()][0]
    groups = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in run(spark, "jaccard", docs).collect()}
    assert groups[2, 0] == 2 and groups[1, 1] == 1 and groups[None, 0] is None


def test_mixed_rows_take_what_the_mix_says(spark):
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (1, "d e f g", "en", "s"), (None, "h i", "en", "t"), (None, "h i", "en", "t"), (2, None, "en", "t"), (3, "j", "en", None)]
    docs = odd(spark, rows)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    words = lambda df, c: {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(c)).collect()}
    want = {k: v for k, v in words(mixing.mix(docs), "taken").items() if v}
    assert words(mixed.withColumn("n", mixing.word_count("text")), "n") == want
    assert mixed.where("__id <> 'v0' OR `row` <> 'v8'").count() == 0
    assert mixing.mixed_rows(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    """Nulls, empty and repeated texts, clashing names and empty tables in every stage."""
    rows = [(i, f"the cat and the dog {i} sat by the old tree and looked at it", "en", "s") if i % 2 else (i, f"le chat et le chien {i} etaient dans la maison de la ville", "fr", "t") for i in range(10, 130)]
    docs = odd(spark, rows + ROWS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 130)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialise(stage(spark, table, str(tmp_path)), name)
            if name != "encoding":
                assert out.columns == docs.columns
                assert out.where("__text <> 'v1' OR d <> 'v7'").count() == 0
            if name == "language" and table is docs:
                assert out.where("text IS NULL OR trim(text) = ''").count() == 0 and out.count() >= 115
            if name == "near_copies":
                assert out.count() == out.distinct().count()
            table = out


@pytest.mark.parametrize("count", [0, 1, 5, 63, 64, 100, 127, 128, 1000])
def test_shards_by_bounds(spark, count):
    bounds = sorted({int(x) for x in np.random.default_rng(count).integers(-50, 5000, count)})
    keys = [None, -(1 << 63), (1 << 63) - 1, *range(-60, 5100, 37), *bounds]
    rows = spark.createDataFrame([(k,) for k in keys], "key bigint").select("key", shard_of(F.col("key"), bounds).alias("s")).collect()
    assert all(r["s"] == (0 if r["key"] is None else sum(b <= r["key"] for b in bounds)) for r in rows)
