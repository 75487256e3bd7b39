"""Near-duplicate groups by SuperMinHash signatures (operator 13).

1. *Signatures.* In round j every shingle of a set draws a rank between j and j + 1 and a slot
   of those that it hasn't drawn yet (a random permutation, shuffled as far as it is needed).
   A slot keeps its least rank.  A set whose slots all hold ranks below j is done, as later
   rounds can't lower them: long texts are done after a few rounds.  Two sets agree in a slot
   with a chance equal to their Jaccard similarity, and as a shingle's slots are a permutation
   the count of agreeing slots varies less than with independent hashes.
2. *Bands.* ``ROWS`` slots are a band; sets that agree in one of ``BANDS`` bands are candidates,
   if their sizes allow the similarity, two bits of each slot don't differ in more than
   ``most_different`` slots, and their odd sketches differ in no more bits than a pair at the
   threshold has differing shingles (each flips one bit, so this filter loses no pair).
3. *Verification* by the full shingle sets, once a pair.  Texts are read again for the sets that
   have a candidate.  Two rounds, each of ``LEADING`` bands, verify each set against one leader
   of its bands, then the candidates of all bands whose ends are in different components are
   verified, whatever their number, so a group of near copies costs its size and not its square.
4. *Groups.* Each task joins up its links by union-find; the forests of all tasks are joined up
   by alternating star contraction.

Recall: a pair at exactly 0.85 is no candidate with a chance of 7e-7 (no band agrees, 0.62**30)
plus 1e-8 (the two bits differ too often); at 0.9 the chance is below 1e-9.

Defined results: a text without words, empty or null, has an empty set and links with nothing;
texts with fewer words than a shingle have one shingle of all their words; rows with equal
texts are one group; a null id is passed over where the smallest id of a group is taken, unless
there is no other; other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import discard, materialise, returning_memory
from loregraph.llm.components import merged
from loregraph.llm.jaccard_join import component_ids, links_of
from loregraph.llm.shingles import U, set_key, shingle_sets, splitmix

ROWS, BANDS = 6, 30
#: Bands whose leaders a round takes, and room for the band's number in a token.
LEADING = 4
NUMBERS = 32
#: 64-bit words of an odd sketch.
SKETCH = 16
SLOTS = ROWS * BANDS
#: Bits of a rank below its round's number.
RANK_BITS = 24
EMPTY = np.uint32(0xFFFFFFFF)
#: Shingles whose permutations are held at once.
CHUNK = 1 << 16
#: Texts whose signatures are made at once.
TEXTS = 2048


def signatures(hashes: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(sets, slots) ranks of the sets whose elements' 64-bit hashes follow each other in ``hashes``; ``EMPTY`` of none."""
    found = np.full((len(sizes), slots), EMPTY, np.uint32)
    owners = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), CHUNK):
        _lower(found, hashes[at : at + CHUNK], owners[at : at + CHUNK])
    return found


def _lower(found: np.ndarray, hashes: np.ndarray, owners: np.ndarray) -> None:
    """Lower the ranks of ``found`` to those of more elements; ``owners`` ascend."""
    slots = found.shape[1]
    permuted = np.tile(np.arange(slots, dtype=np.uint8), (len(hashes), 1))
    at = np.arange(len(hashes))
    open_sets = np.unique(owners)
    is_open = np.zeros(len(found), bool)
    for j in range(slots):
        drawn = splitmix(hashes ^ splitmix(np.array([j + 1], U)))
        other = j + ((drawn >> U(40)) * U(slots - j) >> U(24)).astype(np.int64)
        slot = permuted[at, other]
        permuted[at, other] = permuted[at, j]
        np.minimum.at(found, (owners, slot), (U(j << RANK_BITS) | drawn & U((1 << RANK_BITS) - 1)).astype(np.uint32))
        open_sets = open_sets[found[open_sets].max(axis=1) >= (j + 1) << RANK_BITS]
        if not len(open_sets):
            return
        is_open[:] = False
        is_open[open_sets] = True
        stays = is_open[owners]
        if not stays.all():
            hashes, owners, at = hashes[stays], owners[stays], at[stays]


def bands_of(ranks: np.ndarray) -> np.ndarray:
    """(sets, bands) hashes of the bands of signatures, which end with the band's number."""
    rows = ranks.reshape(len(ranks), -1, ROWS).astype(U)
    mixed = splitmix(np.arange(rows.shape[1], dtype=U))[None, :].repeat(len(ranks), 0)
    for k in range(ROWS):
        mixed = splitmix(mixed ^ rows[:, :, k])
    numbers = np.arange(rows.shape[1], dtype=U)[None, :]
    return (mixed & ~U(NUMBERS - 1) | numbers).view(np.int64)


def bits_of(ranks: np.ndarray) -> np.ndarray:
    """(sets, words) int64: the last two bits of each slot, 32 slots a word."""
    words = -(-ranks.shape[1] // 32)
    two = np.zeros((len(ranks), words * 32), U)
    two[:, : ranks.shape[1]] = ranks & np.uint32(3)
    return np.bitwise_or.reduce(two.reshape(len(ranks), words, 32) << (np.arange(32, dtype=U) * U(2)), axis=2).view(np.int64)


def odd_sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, words) int64: bits that are one where an odd number of a set's elements fell."""
    sketches = np.zeros((len(sizes), SKETCH), U)
    owners = np.repeat(np.arange(len(sizes)), sizes)
    place = ((hashes >> U(40)) & U(SKETCH * 64 - 1)).astype(np.int64)
    np.bitwise_xor.at(sketches, (owners, place >> 6), U(1) << (place & 63).astype(U))
    return sketches.view(np.int64)


def most_different(t: int) -> int:
    """In how many slots two bits of a pair at ``t`` percent differ at most, but for a chance of 1e-8 (Chernoff's bound)."""
    p = (1 - t / 100) * 0.75
    for k in range(math.ceil(SLOTS * p) + 1, SLOTS):
        q = k / SLOTS
        if SLOTS * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p)) if p else 1) >= math.log(1e8):
            return k
    return SLOTS


def passes(a: str, b: str, t: int) -> Column:
    """Length filter, the count of slots in which two bits differ, and that of the sketches' differing bits."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    length = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * t
    low = F.lit(0x5555555555555555)
    words = -(-SLOTS // 32)
    x = [F.get(F.col(f"{a}.bits"), w).bitwiseXOR(F.get(F.col(f"{b}.bits"), w)) for w in range(words + SKETCH)]
    slots = sum((F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 1)).bitwiseAND(low)) for y in x[:words]), F.lit(0))
    odd = sum((F.bit_count(y) for y in x[words:]), F.lit(0))
    least = F.ceil((n_a + n_b) * t / (100.0 + t) - 1e-6)
    return length & (odd <= n_a + n_b - 2 * least) & (slots <= most_different(t))


def leading(number: int) -> Column:
    """Whether a posting's band is one of those whose leaders a round takes."""
    return F.col("token").bitwiseAND(NUMBERS - 1).between(number * LEADING, (number + 1) * LEADING - 1)


def signed_rows(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, r1, r2, n_shingles, set_key, bands, bits) of ``rows(doc_id, r1, r2, text)``; the last three null of an empty set."""
    schema = "doc_id bigint, r1 bigint, r2 bigint, n_shingles bigint, set_key binary, bands array<bigint>, bits array<bigint>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sets = 0, []
            for _, hashes in shingle_sets(batch.column("text"), width):
                sets.append(hashes)
                if len(sets) == TEXTS:
                    yield signed(batch.slice(at, TEXTS), sets)
                    at, sets = at + TEXTS, []
            if sets:
                yield signed(batch.slice(at), sets)

    def signed(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        hashes = np.concatenate(sets)
        ranks = signatures(hashes, sizes)
        none = sizes == 0
        keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
        lists = [fixed_lists(made, none) for made in (bands_of(ranks), np.hstack([bits_of(ranks), odd_sketches(hashes, sizes)]))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "r1", "r2")), pa.array(sizes, pa.int64()), keys, *lists], [c.split(" ")[0] for c in schema.split(", ")])

    return rows.select("doc_id", "r1", "r2", "text").mapInArrow(returning_memory(sign), schema)


def fixed_lists(values: np.ndarray, none: np.ndarray) -> pa.Array:
    """List column of the rows of ``values``; null where ``none``."""
    width = values.shape[1]
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * width, mask=np.append(none, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1), pa.int64()))


def token_sets(rows: DataFrame, width: int) -> DataFrame:
    """(set_key, n, tokens): the full shingle sets of ``rows(set_key, text)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sets = 0, []
            for _, hashes in shingle_sets(batch.column("text"), width):
                sets.append(hashes.view(np.int64))
                if len(sets) == TEXTS:
                    yield made(batch.slice(at, TEXTS), sets)
                    at, sets = at + TEXTS, []
            if sets:
                yield made(batch.slice(at), sets)

    def made(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(sets), pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(sizes, pa.int64()), tokens], ["set_key", "n", "tokens"])

    return rows.select("set_key", "text").mapInArrow(returning_memory(make), "set_key binary, n bigint, tokens array<bigint>")


def spanning_forest(links: DataFrame) -> DataFrame:
    """(a, b): links of which each task keeps one for each node, to the root that union-find gives; the components are the same."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]  # path halving
            return x

        def flush() -> pa.RecordBatch:
            pairs = [(x, find(x)) for x in list(root)]
            root.clear()
            kept = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                low, high = sorted((find(a), find(b)))
                root[high] = low
            if len(root) > 1 << 20:
                yield flush()
        yield flush()

    return links.select("a", "b").mapInArrow(returning_memory(unite), "a binary, b binary")


def near_groups(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``kept``: the row's id is its group's smallest."""
    t = percent
    name = F.col(id_col).cast("bigint")
    # 128 bits that tell a row by its id and text
    rows = docs.select(name.alias("doc_id"), F.xxhash64(name, F.col(text)).alias("r1"), F.xxhash64(F.col(text), name.isNull(), name).alias("r2"), F.col(text).alias("text"))
    signed = materialise(signed_rows(rows, width), "signed")
    sets = materialise(signed.where("set_key IS NOT NULL").select("set_key", "r1", "r2", F.col("n_shingles").alias("n"), "bands", "bits").dropDuplicates(["set_key"]), "sets")
    profiles, posted = candidates_of(rows, sets, width)
    links, labels = links_of(profiles, posted, t, passes, lambda labels, links: merged(labels, spanning_forest(links)), leading)
    discard(*links, sets)
    found = component_ids(signed.select("doc_id", "n_shingles", "set_key"), labels)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def candidates_of(rows: DataFrame, sets: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(profiles, postings) for ``links_of``, both written, of the sets that share a band with another one."""
    bands = sets.select("set_key", F.explode("bands").alias("band"))
    # written, so that the join below has both sides dealt anew and a large band can be split
    shared = materialise(bands.groupBy("band").agg(F.count("*").alias("met")).where("met > 1"), "bands")
    met = materialise(bands.join(shared, "band"), "met")
    # a set that meets many others is in the middle of its group: it leads
    weights = met.groupBy("set_key").agg(F.sum("met").alias("weight"))
    able = materialise(sets.join(weights, "set_key").select("set_key", "r1", "r2", "n", "weight", "bits"), "able")
    posted = met.select("band", "set_key").join(able, "set_key").select(F.col("band").alias("token"), F.struct("weight", F.col("set_key").alias("key"), "n", "bits").alias("p"))
    posted = materialise(posted, "postings")
    # one row of several equal ones
    texts = rows.select("r1", "r2", "text").join(able.select("r1", "r2", "set_key"), ["r1", "r2"]).dropDuplicates(["r1", "r2"])
    profiles = materialise(token_sets(texts, width), "profiles")
    discard(shared, met, able)
    return profiles, posted


def op13_super_minhash(spark, sf_dir: str) -> DataFrame:
    """Whole table: 3-word shingles, Jaccard similarity of 0.85 or more."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
