"""Token rollups: equality with a brute-force count, signed changes, idempotent commits."""

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loregraph.llm.common import new_folder
from loregraph.llm.token_rollups import TokenRollups, op10_token_rollups

SCHEMA = "kind string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long, docs string"


def change(kind, source, lang, tokenizer, tokens, old=(None, None, None, None)):
    return (kind, source, lang, tokenizer, tokens, *old, "x")


def test_same_rows_as_brute_force(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    seen, docs, tokens = set(), Counter(), Counter()
    for r in rows:
        if r.text is not None and r.text in seen:
            continue
        seen.add(r.text)
        docs[r.source, r.lang] += 1
        tokens[r.source, r.lang] += len(library.encode(r.text or "", add_special_tokens=False).ids)
    want = sorted((*key, "byte_bpe_50k", n, tokens[key]) for key, n in docs.items())
    assert sorted(map(tuple, op10_token_rollups(spark, "/root/testdata/sf0.001").collect())) == want


def test_without_old_columns(spark):
    store = TokenRollups(spark, new_folder(spark, "rollups"))
    assert store.commit("1", spark.createDataFrame([("insert", "a", "en", "t", 3)], "kind string, source string, lang string, tokenizer string, tokens long"))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 1, 3)]


def test_a_batch_during_compaction_counts_once(spark, monkeypatch):
    store = TokenRollups(spark, new_folder(spark, "rollups"))
    rows = spark.createDataFrame([change("insert", "a", "en", "t", 5)], SCHEMA)
    store.commit("1", rows)
    sums = store._sums

    def late(names):
        monkeypatch.undo()
        found = sums(names)
        assert store.commit("2", rows)  # comes in while the base is made
        return found

    monkeypatch.setattr(store, "_sums", late)
    assert store.compact()
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 2, 10)]
    assert store.compact() and [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 2, 10)]


def test_signed_changes_and_repeats(spark):
    store = TokenRollups(spark, new_folder(spark, "rollups"))
    assert store.totals().collect() == []
    batch = spark.createDataFrame([change("insert", "a", "en", "t1", 10), change("insert", "a", "en", "t1", 10), change("insert", None, "en", "t1", None)], SCHEMA)
    assert store.commit("1", batch) and not store.commit("1", batch)
    assert sorted(map(tuple, store.totals().collect()), key=str) == sorted([("a", "en", "t1", 2, 20), (None, "en", "t1", 1, 0)], key=str)
    assert store.commit("2", spark.createDataFrame([change("revise", "b", "en", "t2", 7, ("a", "en", "t1", 10)), change("delete", None, "en", "t1", None)], SCHEMA))
    want = [("a", "en", "t1", 1, 10), ("b", "en", "t2", 1, 7)]
    assert sorted(map(tuple, store.totals().collect())) == want
    store.compact()
    assert sorted(map(tuple, store.totals().collect())) == want
    assert not store.commit("2", batch)
    assert store.commit("3", batch.limit(0))
    assert store.commit("4", spark.createDataFrame([change("delete", "b", "en", "t2", 7)], SCHEMA))
    store.compact()
    assert sorted(map(tuple, store.totals().collect())) == want[:1]


def test_unknown_kind_leaves_nothing(spark):
    store = TokenRollups(spark, new_folder(spark, "rollups"))
    with pytest.raises(Exception, match="unknown kind"):
        store.commit("1", spark.createDataFrame([change("upsert", "a", "en", "t1", 1)], SCHEMA))
    assert store.committed() == []
