"""WARC files: exact round trip, copies, and equality with the SQL twin."""

import io
from pathlib import Path

import duckdb
import pytest

from loregraph.llm.warc import OP6_SQL, dictionary_frame, make_record, op6_warc, page_of, parse_record, read_archive, record_id, write_warc


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(con.sql(OP6_SQL).fetchall(), key=str)
    assert sorted(map(tuple, op6_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == want


def test_copies_nulls_and_round_trip(spark):
    page = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "u", page, 1), (3, None, page, 2), (9, "u\nv", page, 3), (1, "a", "short", 4), (2, "a", "short", 5), (4, "b", None, 6), (6, "b", "", 7), (None, "n", page, 8), (7, "l", "long " * 400_000, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, first long")
    found = {r["page_id"]: r for r in write_warc(pages).read().collect()}
    assert {i: r["refers_to"] for i, r in found.items()} == {5: 3, 3: None, 9: 3, 1: None, 2: None, 4: None, 6: None, None: 3, 7: None}
    for i, _, html, _ in rows:
        if found[i]["record_type"] == "response":
            assert bytes(found[i]["payload"]) == (html or "").encode()
        assert found[i]["payload_bytes"] == len((html or "").encode())


def test_repeated_ids_have_records_of_their_own(spark):
    page = "y" * 150
    rows = [(4, "b c\td", page), (4, "b c\td", page), (4, "a", "other " * 40), (7, "z", page)]
    written = write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), shards=1)
    found = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in written.read().collect())
    assert found == [(4, "a", "response", None, 240), (4, "b%20c%09d", "response", None, 150), (4, "b%20c%09d", "response", None, 150), (7, "z", "revisit", 4, 150)]
    assert record_id(4, 0) != record_id(4, 1) and page_of(record_id(4, 1)) == page_of(record_id(4, 0)) == 4
    heads = []
    for file in Path(written.folder.removeprefix("file:")).glob("data/*.zst"):
        with open(file, "rb") as f:
            heads += [parse_record(r)[0]["WARC-Record-ID"] for r in read_archive(f)]
    assert len(set(heads)) == 4


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert write_warc(pages).read().collect() == []


def test_damage_is_seen():
    import zstandard

    record = make_record(1, "u", b"abc" * 50, None, "1970-01-01T00:00:00Z")
    assert parse_record(record)[2] == b"abc" * 50
    with pytest.raises(ValueError):
        parse_record(record.replace(b"abcabc", b"abcabd", 1))
    whole = dictionary_frame(b"") + zstandard.ZstdCompressor().compress(record) * 2
    assert list(read_archive(io.BytesIO(whole))) == [record, record]
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(whole[:-3])))
