"""BPE against the tokenizers library, and token files against it and a plain reader."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loregraph.llm.bpe import Bpe, encode_texts
from loregraph.llm.token_files import frame, library_chunks, op1_token_files, records, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(1)
    yield from ["", "a", "aaaa" * 50, "  x", " \n y", "foo  \nbar", "  \t x\xa0y 　z", "<|endoftext|>a<|endoftext|>", "it's we'll 'S 12 3,4", "日本語", "é" * 30, "\x1c a\x1d", "🙂🙂 x", "éx Ⅷ ²", "ab" * 100_000]
    for _ in range(2000):
        yield "".join(rng.choice(" \n\tabcdeéßñ'sS.,!0129\xa0\x85日") for _ in range(rng.randint(1, 60)))
    for _ in range(50):
        yield "".join(rng.choice("abé") for _ in range(500))


def test_same_ids_as_the_library():
    ours, library = Bpe(PATH), Tokenizer.from_file(PATH)
    for text in odd_texts():
        ids = np.array(ours.encode(text), np.int64)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:80]
        assert ours.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("room", [150_000, 50])
def test_columns_by_chunks(room):
    texts = [*odd_texts(), None, " lead", "trail ", "\n\n", "x" * 2_000_000 + " y", "plain words and more words"] * 2
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for chunks in (Bpe(PATH).chunks, library_chunks(PATH)):
        chunks.room = room
        chunks.forget()
        found = {}
        for first, ids, bounds in chunks.ids(pa.array(texts)):
            found |= {first + i: ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(bounds) - 1)}
        assert [found[i] for i in range(len(texts))] == want
        assert len(chunks.names) <= room
    assert list(Bpe(PATH).chunks.ids(pa.array([], pa.string()))) == []


def test_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (None, None, 6), (1, "a b", 7)], "doc_id bigint, text string, ids int").selectExpr("*", "doc_id AS __text", "doc_id AS `Text_`")
    rows = encode_texts(docs, PATH).collect()
    assert rows[0].asDict().keys() == {"doc_id", "ids", "n_tokens", "decoded", "__text", "Text_"}
    assert sorted((r["doc_id"] or 0, r["n_tokens"], bytes(r["decoded"])) for r in rows) == [(0, 0, b""), (1, 2, b"a b"), (1, 2, b"a b")]
    assert encode_texts(docs.limit(0), PATH).collect() == []


def expected(rows, end=0):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, op1_token_files(spark, "/root/testdata/sf0.001").collect())) == expected(rows)


def test_token_files_edges(spark):
    rows = [(5, "five"), (None, "none"), (2, None), (3, ""), (5, "again <|endoftext|>"), (-7, "word " * 50_000)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, shard int").repartition(3)
    written = write_token_files(docs, PATH, end_id=0, shards=3)
    assert sorted(map(tuple, written.checksums().drop("shard").collect()), key=lambda r: r[1]) == expected(rows)
    index = {(r["doc_id"], r["at"]): r for r in written.index().collect()}
    assert len(index) == len(rows)
    assert write_token_files(docs.limit(0), PATH, end_id=0).read().collect() == []


def test_damage_is_seen():
    import io

    whole = frame(b"abc") + frame(b"")
    assert list(records(io.BytesIO(whole))) == [b"abc", b""]
    for at in (0, 9, 13, len(whole) - 1):
        broken = bytearray(whole)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(records(io.BytesIO(bytes(broken))))
