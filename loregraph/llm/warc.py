"""WARC archives compressed with an embedded Zstandard dictionary (operator 6).

Writer: a dictionary is trained on a bounded sample of payloads.  Each archive file starts
with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed;
after it every record is a Zstandard frame of its own, so a reader can start at any record
that the index names.  An archive is one shard of pages in ascending page id; its file
appears by a rename once it is whole, so a task that runs again replaces it by an equal one.

Copies: of records with equal payloads of at least ``least_bytes`` the one with the smallest
page id is a ``response`` and the others are ``revisit`` records that refer to it.  Which is
which is found on digests and ids alone; payloads are dealt only by page id.

Defined results: a null payload is empty; rows of one page id are in order of URL and payload
and, where equal, all are written; a null page id is never a response that others refer to
unless all copies have none, and then each copy is a response; an empty table gives no file.
Record ids count a page's records from its second on; a revisit names the first record of the
page it refers to, and its digest says which payload.  Blanks in URLs are percent-encoded; no
URL is ``about:blank``.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm.common import committed_output, filesystem, hash_sample, new_folder, ordered_shards, shuffle_partitions

#: The skippable frame that carries a dictionary at the head of an archive. Fixed value.
DICTIONARY_MAGIC = 0x184D2A5D
#: The version line of records. Fixed value.
VERSION = b"WARC/1.1"
LEVEL = 3
CHUNK = 1 << 18


def train_dictionary(payloads: list[bytes], size: int = 96 << 10) -> bytes:
    """A Zstandard dictionary from sample records; empty where there is too little to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, payloads, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard

    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def record_id(page_id: int | None, copy: int = 0) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>" if not copy else f"<urn:page:{'none' if page_id is None else page_id}:{copy}>"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").split(":")[2]
    return None if name == "none" else int(name)


def address(url: str | None) -> str:
    """A URL as a field's value: blanks and control characters are percent-encoded."""
    return "".join(quote(c) if c.isspace() or not c.isprintable() else c for c in url or "about:blank")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, copy: int = 0) -> bytes:
    """A response with its payload, or a revisit with the head of the response alone; ``copy`` counts the page's records before."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", address(url)),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block, b"", b""])


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record; an error where a length or digest is off."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.decode().split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is off")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    http_fields = dict(x.decode().split(": ", 1) for x in http.split(b"\r\n")[1:])
    if fields["WARC-Type"] == "response":
        if len(payload) != int(http_fields["Content-Length"]) or "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
            raise ValueError("a payload doesn't match its digest")
    return fields, http_fields, payload


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one after the other, in bounded memory."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise ValueError("an archive starts with its dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(stream.read(int.from_bytes(head[4:], "little")))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    waiting = stream.read(CHUNK)
    while waiting:
        frame = reader.decompressobj()
        parts = []
        while True:
            parts.append(frame.decompress(waiting))
            if frame.eof:
                waiting = frame.unused_data or stream.read(CHUNK)
                break
            waiting = stream.read(CHUNK)
            if not waiting:
                raise ValueError("an archive is cut short")
        yield b"".join(parts)


@dataclass
class WarcFiles:
    """A folder of archives: ``data/pages-NNNNNN.warc.zst`` and ``index``."""

    spark: SparkSession
    folder: str

    def index(self) -> DataFrame:
        """(page_id, shard, at, bytes): where each record's frame lies."""
        return self.spark.read.parquet(f"{self.folder}/index")

    def read(self) -> DataFrame:
        """All records of all archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

        A revisit's bytes and digest are those of the payload that it doesn't repeat; its ``payload`` is null.
        """
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri in batch.column("file").to_pylist():
                    files, path = filesystem(uri)
                    rows, held = [], 0
                    with files.open_input_stream(path, compression=None) as stream:
                        for record in read_archive(stream):
                            fields, http, payload = parse_record(record)
                            refers = fields.get("WARC-Refers-To")
                            first = fields["WARC-Type"] == "response"
                            rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), page_of(refers) if refers else None, payload if first else None))
                            held += len(record)
                            if held > 8 << 20:
                                yield batch_of(rows)
                                rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

        def batch_of(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        shards = self.index().select("shard").distinct()
        count = (self.index().agg(F.max("shard")).first()[0] or 0) + 1
        named = shards.select("shard", F.format_string("%s/data/pages-%06d.warc.zst", F.lit(self.folder), F.col("shard")).alias("file"))
        return named.repartitionById(count, F.col("shard")).mapInArrow(scan, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def responses(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, first): of each group of copies the page that keeps its payload, by page."""
    digest = F.sha2("payload", 256)
    marks = pages.select("page_id", digest.alias("digest"), F.octet_length("payload").alias("size"))
    copies = marks.where(F.col("size") >= least_bytes)
    groups = copies.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").select("digest", "first")
    # small rows, without payloads; a group of very many copies is split by the skew join
    return copies.join(groups, "digest").select("page_id", "digest", "first").distinct()


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 100, sample: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url: str = "url", payload: str = "html", shards: int | None = None) -> WarcFiles:
    """Write a record for each row, in ascending order of ``id_col``.

    ``sample``: records that the dictionary is trained on, at most (a documented bound), each
    of at most 16 KiB.  ``date``: the records' WARC-Date, as pages have none of their own.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    drawn = hash_sample(rows.select("page_id", "url", F.substring("payload", 1, 16 << 10).alias("part")), F.xxhash64("page_id", "url"), sample)
    dictionary = train_dictionary([bytes(r["part"]) for r in drawn.orderBy("key").collect() if r["part"]])
    # which page a copy refers to goes to its shard as a row of its own, before it: payloads are dealt once
    refers = responses(rows, least_bytes).where("page_id IS NULL OR page_id <> first")
    both = rows.withColumns({"digest": F.lit(None).cast("string"), "first": F.lit(None).cast("bigint"), "is_page": F.lit(1)})
    both = both.unionByName(refers.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first", F.lit(0).alias("is_page")))
    ordered = ordered_shards(both, "page_id", shards or shuffle_partitions(spark), ["is_page", "url", "payload"])
    names = ["page_id", "shard", "at", "bytes"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        if dictionary:
            options["dict_data"].precompute_compress(LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, **options)
        shard = batch.column("shard")[0].as_py()  # a task has one shard
        with committed_output(f"{folder}/data/pages-{shard:06d}.warc.zst") as stream:
            head = dictionary_frame(dictionary)
            stream.write(head)
            at = len(head)
            now, known, copy = object(), {}, 0
            while batch is not None:
                found = []
                for page_id, uri, body, digest, first, is_page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "is_page")), strict=True):
                    if page_id != now:
                        now, known, copy = page_id, {}, 0
                    if not is_page:
                        known[digest] = first
                        continue
                    refers_to = known.get(hashlib.sha256(body).hexdigest()) if known else None
                    frame = compressor.compress(make_record(page_id, uri, body, refers_to, date, copy))
                    stream.write(frame)
                    copy += 1
                    found.append((page_id, shard, at, len(frame)))
                    at += len(frame)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                batch = next(batches, None)

    ordered.mapInArrow(write, "page_id bigint, shard int, at bigint, bytes bigint").write.parquet(f"{folder}/index")
    return WarcFiles(spark, folder)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table: every page written as a record and read back from the archives."""
    written = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return written.read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH marked AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM marked WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, m.payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM marked m LEFT JOIN firsts f ON m.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
