"""Token-id files (operator 1): length-delimited binary records with a separate offset index.

A data file is one shard of documents in ascending id order.  Each record is framed as

    8 bytes   payload length, little-endian unsigned
    4 bytes   masked CRC-32 of those 8 bytes
    payload   1 byte flags (1: has an id), 8 bytes id, then the token ids
    4 bytes   masked CRC-32 of the payload

The mask is the usual one of record files: the checksum rotated right by 15 bits plus a
constant, so that a checksum stored inside checksummed data does no harm.  Token ids take
2 bytes where the vocabulary allows it and 4 otherwise; ``meta`` says which.

The index is a Parquet table (doc_id, shard, at, bytes, n_tokens): one row a record, enough
to read any record on its own, so a trainer can shuffle the index instead of the data.

Shards are cut by approximate quantiles of the id; a shard depends on its rows alone and
its file appears by a rename once it is whole, so a task that runs again replaces it by an
equal one.

Defined results: a null text is the empty text (the end id alone); rows without an id come
first; rows with equal ids follow each other in the order of their texts, each with a record.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregraph.llm.chunks import BLANK, LONGEST, OTHER_SPACE, Chunks, Encoder, by_strings
from loregraph.llm.common import committed_output, filesystem, new_folder, ordered_shards, shuffle_partitions
from loregraph.llm.shingles import texts_of

#: The masking constant of length-delimited record files. Fixed value.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
IDENTITY = struct.Struct("<Bq")


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def payload_of(doc_id: int | None, ids: bytes) -> bytes:
    return IDENTITY.pack(doc_id is not None, doc_id or 0) + ids


def parse(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    """The id and the token ids of a payload."""
    has_id, doc_id = IDENTITY.unpack_from(payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=IDENTITY.size)


def frame(payload: bytes) -> bytes:
    """One record with its length and both checksums."""
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, TAIL.pack(masked_crc(size)), payload, TAIL.pack(masked_crc(payload))))


def records(stream) -> Iterator[bytes]:
    """The payloads of a stream of records; an error where a checksum or length is off."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("a record's head is cut short")
        size, crc = HEAD.unpack(head)
        if crc != masked_crc(head[:8]):
            raise ValueError("a record's length doesn't match its checksum")
        payload = stream.read(size)
        tail = stream.read(TAIL.size)
        if len(payload) < size or len(tail) < TAIL.size:
            raise ValueError("a record is cut short")
        if TAIL.unpack(tail)[0] != masked_crc(payload):
            raise ValueError("a record's payload doesn't match its checksum")
        yield payload


#: Chunks that the library is given as one text: a call costs as much as some tokens.
TOGETHER = 64


def library_encoder(tokenizer) -> Encoder:
    """Ids of strings by the tokenizers library.

    Chunks that start with a blank are encoded side by side, as in a text, and told apart by
    how many bytes each token stands for.
    """
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a byte is a character in byte-level vocabularies
    apart = "|".join([OTHER_SPACE, *(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
    single = by_strings(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = texts_of(texts)
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = BLANK[data[offsets[:-1]]] & ~BLANK[data[offsets[1:] - 1]] & (np.diff(offsets) <= LONGEST)
        joined &= ~pc.match_substring_regex(texts, apart).to_numpy(zero_copy_only=False)
        data, offsets = texts_of(texts.filter(pa.array(joined)))
        cuts = np.append(offsets[:-1:TOGETHER], offsets[-1]).tolist()
        lots = tokenizer.encode_batch_fast([data[low:high].tobytes().decode() for low, high in pairwise(cuts)], add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in lots)])
        ends = np.searchsorted(np.cumsum(lengths[flat]), offsets[1:] - offsets[0]) + 1
        rest, rest_starts, rest_sizes = single(texts.filter(pa.array(~joined)))
        starts, sizes = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        starts[joined], sizes[joined] = np.append(0, ends)[:-1], np.diff(ends, prepend=0)
        starts[~joined], sizes[~joined] = rest_starts + len(flat), rest_sizes
        return np.concatenate([flat, rest]), starts, sizes

    return encode


_CHUNKS: dict[str, Chunks] = {}


def library_chunks(path: str) -> Chunks:
    """This worker's tokenizers library behind ``Chunks``; one tokenizer is kept."""
    if path not in _CHUNKS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _CHUNKS.clear()
        _CHUNKS[path] = Chunks(library_encoder(tokenizer), specials)
    return _CHUNKS[path]


@dataclass
class TokenFiles:
    """A folder of token-id files: ``data/shard-NNNNNN.rec``, ``index``, ``meta.json``."""

    spark: SparkSession
    folder: str

    def meta(self) -> dict:
        files, path = filesystem(f"{self.folder}/meta.json")
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def shards(self) -> DataFrame:
        """One row a shard: its file, records, tokens, and the tokens of all shards before it."""
        by = self.index().groupBy("shard").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("tokens"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
        name = F.format_string("%s/data/shard-%06d.rec", F.lit(self.folder), F.col("shard"))
        return by.select("shard", "records", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"), name.alias("file"))

    def read(self) -> DataFrame:
        """Every record from the data files, in order within a shard: doc_id, shard, start, n_tokens, ids.

        ``ids`` are little-endian unsigned 32-bit; ``start`` counts the ids of all records before.
        """
        return self._read("doc_id bigint, shard int, start bigint, n_tokens bigint, ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())

    def checksums(self) -> DataFrame:
        """As ``read``, with ``ids_crc32`` (unsigned, over 32-bit ids) in place of the ids."""
        return self._read("doc_id bigint, shard int, start bigint, n_tokens bigint, ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())

    def _read(self, schema: str, row, kind) -> DataFrame:
        width = self.meta()["bytes_per_id"]
        names = [c.split(" ")[0] for c in schema.split(", ")]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, start, uri in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "file")), strict=True):
                    files, path = filesystem(uri)
                    with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                        rows, held = [], 0
                        for payload in records(stream):
                            doc_id, ids = parse(payload, width)
                            rows.append((doc_id, shard, start, len(ids), row(ids)))
                            start += len(ids)
                            held += len(payload)
                            if held > 8 << 20:
                                yield batch_of(rows)
                                rows, held = [], 0
                        if rows:
                            yield batch_of(rows)

        def batch_of(rows) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        shards = self.shards().select("shard", "start", "file")
        return shards.repartitionById(self.meta()["shards"], F.col("shard")).mapInArrow(scan, schema)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", shards: int | None = None) -> TokenFiles:
    """Encode ``text``, append ``end_id``, and write records in ascending order of ``key``.

    ``tokenizer``: path of a byte-level ``tokenizer.json`` that every executor has.
    ``folder``: URI in a file system that all executors share (one is made if absent).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    kind = f"<u{width}"
    end = np.array([end_id], kind).tobytes()
    ordered = ordered_shards(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "doc_id", shards or shuffle_partitions(spark), ["text"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library_chunks(tokenizer)
        names = ["doc_id", "shard", "at", "bytes", "n_tokens"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        shard = batch.column("shard")[0].as_py()  # a task has one shard
        with committed_output(f"{folder}/data/shard-{shard:06d}.rec") as stream:
            at = 0
            while batch is not None:
                rows = []
                names_of = batch.column("doc_id").to_pylist()
                for first, ids, bounds in chunks.ids(batch.column("text")):
                    packed, cuts = ids.astype(kind).tobytes(), (bounds * width).tolist()
                    for i in range(len(cuts) - 1):
                        doc_id = names_of[first + i]
                        record = frame(payload_of(doc_id, packed[cuts[i] : cuts[i + 1]] + end))
                        stream.write(record)
                        rows.append((doc_id, shard, at, len(record), (cuts[i + 1] - cuts[i]) // width + 1))
                        at += len(record)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                batch = next(batches, None)

    index = ordered.mapInArrow(write, "doc_id bigint, shard int, at bigint, bytes bigint, n_tokens bigint")
    index.write.parquet(f"{folder}/index")
    count = spark.read.parquet(f"{folder}/index").agg(F.max("shard")).first()[0]
    files, path = filesystem(f"{folder}/meta.json")
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as f:
        f.write(json.dumps({"bytes_per_id": width, "end_id": end_id, "shards": (count if count is not None else 0) + 1}).encode())
    return TokenFiles(spark, folder)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table: written as token-id files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return written.checksums().select("doc_id", "start", "n_tokens", "ids_crc32")
