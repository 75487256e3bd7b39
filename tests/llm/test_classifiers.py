"""Language ID and quality: held-out accuracy and defined edge results."""

import zlib

from loregraph.llm import language_id, quality


def test_language_held_out(spark):
    found = language_id.op8_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog are here " * 3, "en", "x") for i in range(30)] + [(i + 100, "der hund und die katze sind hier " * 3, "de", "x") for i in range(30)]
    rows += [(300, None, "en", "x"), (301, "", "en", "x"), (302, "123 !!", "de", "x"), (303, "the dog", None, "x"), (None, "der hund " * 100_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    model = language_id.fit(docs)
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [found[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3
    assert found[303]["lang_pred"] == "en" and found[None]["lang_pred"] == "de"
    none = language_id.fit(docs.where("lang IS NULL"))
    assert none is None
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).collect() == []


def test_rare_languages_and_late_windows_are_learned(spark):
    import numpy as np

    rows = [(i, f"the cat and the dog number {i} are here " * 3, "en") for i in range(900)] + [(i + 5000, "кот и собака всегда здесь дома " * 3, "ru") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, sample=40)
    assert model.languages == ["en", "ru"]
    assert {r["lang_pred"] for r in language_id.identify(docs, model).where("lang = 'ru'").collect()} == {"ru"}
    same = b"0" * 2048
    model = language_id.train([same + x * 4096 for x in (b"a", b"b") for _ in range(40)], ["a"] * 40 + ["b"] * 40)
    late = model.probabilities(np.frombuffer(b"a" * 256 + b"b" * 256, np.uint8).reshape(2, 256), model.prepare())
    assert late[0, 0] > 0.8 and late[1, 1] > 0.8


def test_quality_held_out(spark):
    found = quality.op9_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = [r for r in found.join(labels, "doc_id").collect() if r["held_out"]]
    right = {q: [r["predicted"] == q for r in rows if r["quality"] == q] for q in (0, 1)}
    assert all(sum(x) >= 0.9 * len(x) for x in right.values()) and len(rows) > 500


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "good words in a row of text. " * 5 if i % 2 else "JUNK!! %%% JUNK!! &&& " * 5, i) for i in range(200)] + [(500, None, 1), (501, "", 1), (502, "good words " * 200_000, 1)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    found = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(found) == 203 and all(0 <= r["score"] <= 1 for r in found.values())
    assert found[2]["predicted"] == 0 and found[3]["predicted"] == 1
    assert found[500]["score"] == found[501]["score"]
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
