"""BPE encoding and decoding (operator 7).

Encoder: a pretoken's byte-level BPE result is the only sequence of tokens in which
every neighbouring pair is *compatible*, that is, a pair that merging in rank order
would leave side by side.  An Aho-Corasick automaton over the reversed vocabulary
gives, in one pass, the longest token that starts at each place.  A scan from the left
takes the longest token that is compatible with the one before it, goes on to shorter
ones, and steps back where none fits; each place is given up at most once, so the time
is linear in the pretoken's length whatever it holds.  Compatibility of a pair is found
by undoing merges on both sides of the boundary and is kept in a table.

Decoder: all tokens' bytes lie in one array with an offset table; ids gather their bytes.

Defined results: null text encodes as the empty text, which gives no ids; a special
token's string in the text gives its id, as the tokenizers library does by default.
Every row gives a row, repeated ones too; columns beside the text are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.chunks import Chunks, by_strings
from loregraph.llm.common import quoted, returning_memory, schema_of, unused_name, without

#: GPT-2's published pretoken pattern, which byte-level tokenizer files imply. Fixed value.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Bpe:
    """Tables of one tokenizer file: automaton, splits, merges, offsets. Made once in a worker."""

    def __init__(self, path: str, known_pairs: int = 300_000):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *specials.values()]) + 1
        self.pretokens = regex.compile(PRETOKENS)
        self.specials = specials
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None

        # rank order, which decides merges, can differ from id order
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {vocab[c]: -1 for c in to_byte if c in vocab}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(pairs):
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.merge[a, b] = rank
            if both not in self.rank:
                self.rank[both] = rank
                self.split[both] = (a, b)
        self.length = [0] * size
        chunks = [b""] * size
        for token, i in vocab.items():
            chunks[i] = bytes(to_byte[c] for c in token)
            self.length[i] = len(token)
        for token, i in specials.items():
            chunks[i] = token.encode()
            self.length[i] = len(chunks[i])
        self.whole: dict[int, bool] = {}
        self.compatible_pairs: dict[int, bool] = {}
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(c) for c in chunks], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(chunks), np.uint8)

        usable = {t: i for t, i in vocab.items() if i in self.rank and self.merges_whole(i)}
        self.automaton = ahocorasick.Automaton()
        for i in usable.values():
            self.automaton.add_word(chunks[i][::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = {i: next((usable[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in usable), -1) for token, i in usable.items()}
        self.known_pairs = known_pairs
        self.chunks = Chunks(by_strings(lambda texts: [self.encode(t) for t in texts]), [*specials])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging in rank order can leave ``left`` and ``right`` side by side."""
        known = self._compatible(left, right)
        if len(self.compatible_pairs) >= self.known_pairs:
            self.compatible_pairs.clear()
        self.compatible_pairs[left << 32 | right] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges, again and again. A merge across
        # the boundary would have come first if its rank is below that of a merge undone.
        undone = len(self.merge) + 1
        while True:
            across = self.merge.get((left, right))
            # an equal pair to the left of another is merged first, as a strict comparison says
            if across is not None and across < undone:
                return False
            rank_left, rank_right = self.rank[left], self.rank[right]
            if rank_left < 0 and rank_right < 0:
                return True
            if rank_left > rank_right:
                undone = rank_left
                left = self.split[left][1]
            else:
                # a merge at the same rank that starts further left is made before
                undone = rank_right + 1
                right = self.split[right][0]

    def encode_pretoken(self, pretoken: str) -> list[int]:
        """Token ids of one pretoken, exactly as merging in rank order gives them."""
        text = pretoken.encode()
        size = len(text)
        longest = [-1] * size
        last = size - 1
        for end, token in self.automaton.iter(text[::-1].decode("latin-1")):
            if longest[last - end] < 0:
                longest[last - end] = token  # the longest match of a place is reported first
        length, shorter, pairs = self.length, self.shorter, self.compatible_pairs
        token = longest[0]
        if length[token] == size:
            return [token]
        closed: set[int] = set()  # places from which no tokens lead to the end
        tokens: list[int] = []
        at = 0
        before = -1
        while True:
            while token >= 0:
                end = at + length[token]
                if end not in closed:
                    if before < 0:
                        break
                    fits = pairs.get(before << 32 | token)
                    if fits or fits is None and self.compatible(before, token):
                        break
                token = shorter[token]
            else:
                closed.add(at)
                token = tokens.pop()
                at -= length[token]
                before = tokens[-1] if tokens else -1
                token = shorter[token]
                continue
            tokens.append(token)
            if end == size:
                return tokens
            at, before = end, token
            token = longest[at]

    def merges_whole(self, token: int) -> bool:
        """Whether the token's own bytes do merge into it (a vocabulary can hold ones that never arise)."""
        known = self.whole.get(token)
        if known is None:
            parts = self.split.get(token)
            known = parts is None or (self.merges_whole(parts[0]) and self.merges_whole(parts[1]) and self._joins(*parts))
            self.whole[token] = known
        return known

    def _joins(self, left: int, right: int) -> bool:
        """No merge across the boundary of the two parts comes before the one that joins them."""
        undone = len(self.merge) + 1
        first = True
        while True:
            across = self.merge.get((left, right))
            if not first and across is not None and across < undone:
                return False
            first = False
            rank_left, rank_right = self.rank[left], self.rank[right]
            if rank_left < 0 and rank_right < 0:
                return True
            if rank_left > rank_right:
                undone = rank_left
                left = self.split[left][1]
            else:
                undone = rank_right + 1
                right = self.split[right][0]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if self.special_split is None or not any(t in text for t in self.specials):
            return self._encode(text)
        parts = self.special_split.split(text)
        return [i for p in parts if p for i in ([self.specials[p]] if p in self.specials else self._encode(p))]

    def _encode(self, text: str) -> list[int]:
        pretokens = self.pretokens.findall(text)
        return self.encode_pretoken(pretokens[0]) if len(pretokens) == 1 else [i for p in pretokens for i in self.encode_pretoken(p)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, side by side."""
        ids = ids.astype(np.int64)
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        places = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
        return self.bytes[places].tobytes()


_TABLES: dict[str, Bpe] = {}


def tables(path: str) -> Bpe:
    """This worker's tables of a tokenizer file; one file's are kept."""
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = Bpe(path)
    return _TABLES[path]


def decimal_list(ids: np.ndarray, numbers: list[str]) -> bytes:
    """Decimal ids joined by commas."""
    return ",".join([numbers[i] for i in ids.tolist()]).encode()


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode a text column, then decode the ids again.

    ``tokenizer``: path of a byte-level BPE ``tokenizer.json`` that every executor has.
    Returns the ``keep`` columns (all but the text by default, whatever their names) and ``ids`` (binary,
    little-endian unsigned 32-bit), ``n_tokens``, ``decoded`` (binary).  Columns of these
    names in ``docs`` are replaced.
    """
    made = {"ids": "binary", "n_tokens": "bigint", "decoded": "binary"}
    return _encoded(docs, tokenizer, text, keep, made, lambda ids, bpe, _: (ids.tobytes(), len(ids), bpe.decode(ids)))


def encode_digests(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As ``encode_texts``, but with SHA-256 digests of the decimal ids and of the decoded text."""
    made = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}

    def digests(ids, bpe, numbers):
        decoded = bpe.decode(ids).decode("utf-8", errors="replace").encode()
        return len(ids), hashlib.sha256(decimal_list(ids, numbers)).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _encoded(docs, tokenizer, text, keep, made, digests)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, name: str = "n_tokens") -> DataFrame:
    """The ``keep`` columns (all but the text by default) and how many tokens the text has; null has none."""
    keep = without([c for c in (keep if keep is not None else docs.columns) if c != text], name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = tables(tokenizer).chunks
        for batch in batches:
            sizes = [np.diff(bounds) for _, _, bounds in chunks.ids(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int64())], [*keep, name])

    return docs.select(*quoted(keep), F.col(text).alias(unused_name("text", *keep))).mapInArrow(returning_memory(count), schema_of(docs, keep, {name: "bigint"}))


def _encoded(docs: DataFrame, tokenizer: str, text: str, keep, made: dict[str, str], row) -> DataFrame:
    keep = without([c for c in (keep if keep is not None else docs.columns) if c != text], *made)
    schema = schema_of(docs, keep, made)
    arrow = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    given = unused_name("text", *keep)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(tokenizer)
        numbers = [str(i) for i in range(len(bpe.length))]
        for batch in batches:
            rows = []
            for _, ids, bounds in bpe.chunks.ids(batch.column(len(keep))):
                rows += [row(ids[low:high], bpe, numbers) for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = batch.columns[: len(keep)] + [pa.array([r[i] for r in rows], arrow[t]) for i, t in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *made])

    return docs.select(*quoted(keep), F.col(text).alias(given)).mapInArrow(returning_memory(encode), schema)


def op7_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Whole table: ids and decoded text of every document, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
