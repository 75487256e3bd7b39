"""The pipeline's stages, each against what its operator says and a brute-force end."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loregraph.llm import language_id, mixing, quality
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, outs[-1], SF).cache())
    assert all(o.columns == docs.columns for o in outs[:-1])
    ids = [[r.doc_id for r in o.select("doc_id").collect()] for o in outs]
    first = {r.doc_id for r in language_id.identify(docs, language_id.fit(docs)).where("lang_pred <> 'und' AND score >= 0.3").collect()}
    assert set(ids[1]) == first and len(ids[1]) > 0.95 * len(ids[0])
    model = quality.fit(outs[1], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(ids[2]) == {r.doc_id for r in quality.score(outs[1], model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in outs[2].collect()]
    assert sorted(ids[3]) == [d for d, _, c in brute(rows) if d == c]
    plan = {r.doc_id: (r["taken"], r["size"]) for r in mixing.mix(outs[3]).collect()}
    words = Counter()
    for r in outs[4].select("doc_id", mixing.word_count("text").alias("n")).collect():
        words[r.doc_id] += r.n
    assert {d: n for d, (n, _) in plan.items() if n} == {d: n for d, n in words.items() if n}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in outs[4].collect():
        found = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, outs[5].collect())) == want


@pytest.mark.parametrize("count", [2, 3, 4, 40])
def test_language_least_score_is_above_chance(spark, monkeypatch, count):
    names = [f"l{i}" for i in range(count)]
    zero = [np.zeros((w, 256, language_id.FILTERS), np.float32) for w in language_id.WIDTHS]
    pooled = language_id.FILTERS * len(zero)
    docs = spark.createDataFrame([(1, "a text", "l0")], "doc_id bigint, text string, lang string")
    kept = []
    for lean in (0.0, 3.0):  # a model that doesn't know the text, and one that leans to a language
        offset = np.array([lean] + [0.0] * (count - 1), np.float32)
        model = language_id.ByteCnn(names, zero, np.zeros(pooled, np.float32), np.zeros((pooled, count), np.float32), offset)
        monkeypatch.setattr(language_id, "fit", lambda docs, model=model: model)
        kept.append(corpus_pipeline.language(spark, docs, SF).count())
    assert kept == [0, 1]


def test_near_copies_of_null_and_repeated_ids(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, long, "a"), (None, long + " end", "a"), (3, other, "b"), (3, "alone " * 9, "b"), (3, other, "c"), (2, other + " end", "a"), (None, "on its own " * 3, "a"), (None, "", "a"), (None, long, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert len(found) == 5
    assert {(None, "", "a"), (None, "on its own " * 3, "a"), (3, "alone " * 9, "b"), (2, other + " end", "a")} < set(found)
    assert len(set(found) & {(None, long, "a"), (None, long + " end", "a")}) == 1
