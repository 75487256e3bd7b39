"""Document fingerprints (operator 5): randomised edit embedding, bit-sampled.

Two pointers walk a text and its embedding.  At step j the embedding takes the text's
current character, and a random function of (j, character), the same for all texts, says
whether the text's pointer moves on.  Texts that differ by an edit fall out of step and,
by the same random choices, soon into step again, so edit distance becomes Hamming distance
between embeddings.  A fingerprint samples the embedding: ``PER_SCALE`` fixed places in each
scale [2^k, 2^(k+1)), four bits of the character's hash at each, as a hex digit; a dot stands
beyond the text's end.  Likeness weighs each scale's agreement by the part of the embedding
that it stands for.

The random function has a period of ``PERIOD`` steps, so a character's run (how many steps
the pointer stays) is one look-up, and all texts of a batch walk together, a character a
step, longest first.

Near pairs: bands of sampled digits, from the scale in which a text ends, are join keys;
each text meets leaders of the bands it falls in, then all members of them that are not in
its component yet, and is verified by likeness.

Defined results: null is the empty text; its fingerprint is dots alone, and two such are
alike (1), as an empty and a non-empty text are not (0); equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import discard, materialise, quoted, range_bounds, schema_of, shard_of, shuffle_partitions, unused_name, without
from loregraph.llm.components import merged
from loregraph.llm.shingles import splitmix

PERIOD = 4096
PER_SCALE = 32
#: Scales of the embedding that are sampled: up to 2^31 steps, so about 2^30 characters.
SCALES = 31
#: Characters are told apart by their code points modulo this, a prime, in the random walk alone.
KINDS = 251
U = np.uint64
HEX = np.frombuffer(b"0123456789abcdef.", np.uint8)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = np.arange(2 * PERIOD, dtype=U) % U(PERIOD)
    moves = (splitmix(np.arange(KINDS, dtype=U)[:, None] * U(PERIOD) + steps[None, :]) >> U(40) & U(1)).astype(bool)
    run = np.zeros((KINDS, 2 * PERIOD + 1), np.int64)
    run[:, -1] = 1
    for j in range(2 * PERIOD - 1, -1, -1):  # steps until the pointer has moved on
        run[:, j] = np.where(moves[:, j], 1, run[:, j + 1] + 1)
    places = []
    for k in range(SCALES):
        low = 1 << k
        drawn = splitmix(np.arange(8 * PER_SCALE, dtype=U) + U(k << 32)) % U(low)
        places.append(low + np.unique(drawn[: PER_SCALE] if low > PER_SCALE else np.arange(low, dtype=U)).astype(np.int64))
    return np.minimum(run[:, :PERIOD], 255).astype(np.uint8).ravel(), np.concatenate([p - 1 for p in places]), np.array([0, *np.cumsum([len(p) for p in places])])


RUN, PLACES, SCALE_STARTS = _tables()


def embed(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(digits, ends) of texts given by code points: sampled digits (16: beyond the end), embedding sizes."""
    count = len(codes)
    digits = np.full((count, len(PLACES)), 16, np.uint8)
    ends = np.zeros(count, np.int64)
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return digits, ends
    lengths = sizes[order]
    flat = np.concatenate([codes[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    kinds = (flat % KINDS).astype(np.int64) * PERIOD
    values = (splitmix(flat.astype(U)) >> U(60)).astype(np.uint8)
    at = np.zeros(len(order), np.int64)  # place in the embedding
    taken = np.zeros(len(order), np.int64)  # samples filled
    active = len(order)
    nexts = np.append(PLACES, np.iinfo(np.int64).max)
    due = np.full(len(order), nexts[0])
    for i in range(int(lengths[0])):
        while lengths[active - 1] <= i:
            active -= 1
        here = starts[:active] + i
        a = at[:active]
        a += RUN[kinds[here] + (a & (PERIOD - 1))]
        hit = np.flatnonzero(due[:active] < a)
        while len(hit):
            slots = taken[hit]
            digits[order[hit], slots] = values[here[hit]]
            slots += 1
            taken[hit] = slots
            later = nexts[slots]
            due[hit] = later
            hit = hit[later < a[hit]]
    ends[order] = at
    return digits, ends


def render(digits: np.ndarray) -> list[str]:
    """Fingerprint strings: the digits up to the text's end, then dots to the end of its scale."""
    out = []
    for row in HEX[digits]:
        text = row.tobytes().decode()
        filled = len(text.rstrip("."))
        scale = int(np.searchsorted(SCALE_STARTS, filled, "left"))
        out.append(text[: SCALE_STARTS[scale]] or ".")
    return out


def likeness(a: str, b: str) -> float:
    """Share of the embedding in which two fingerprints agree, 0 to 1."""
    if a == b:
        return 1.0
    size = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(size, ".").encode(), np.uint8) for s in (a, b))
    used = (x != 46) | (y != 46)
    same = (x == y) & used
    total = agreed = 0.0
    for k in range(SCALES):
        part = slice(SCALE_STARTS[k], SCALE_STARTS[k + 1])
        if part.start >= size:
            break
        weight = (1 << k) / (part.stop - part.start)  # steps that a sample stands for
        total += weight * used[part].sum()
        agreed += weight * same[part].sum()
    return float(agreed / total) if total else 0.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Characters walked together.
TOGETHER = 6 << 20


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``fingerprint``; a column of this name is replaced."""
    keep = without(keep if keep is not None else docs.columns, "fingerprint")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fingerprints(texts), pa.string())], [*keep, "fingerprint"])

    return docs.select(*quoted(keep), F.col(text).alias(unused_name("text", *keep))).mapInArrow(walk, schema_of(docs, keep, {"fingerprint": "string"}))


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of texts, walked together in lots of bounded size."""
    out: list[str] = []
    lot: list[np.ndarray] = []
    held = 0
    for text in texts:
        codes = code_points(text)
        if held and held + len(codes) > TOGETHER:
            out += render(embed(lot)[0])
            lot, held = [], 0
        lot.append(codes)
        held += len(codes)
    return out + (render(embed(lot)[0]) if lot else [])


#: Rounds in which each text meets one member of each of its bands, before the rest of the band is verified.
LEADER_ROUNDS = 2


def band_places(size: int, bands: int, digits: int) -> list[np.ndarray]:
    """The different choices of places of a scale with ``size`` samples, drawn ``digits`` at a time."""
    drawn = splitmix(np.arange(bands, dtype=U)[:, None] * U(1000) + np.arange(digits, dtype=U)) % U(size)
    return [np.array(places) for places in dict.fromkeys(tuple(np.unique(row).tolist()) for row in drawn)]


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """``likeness`` of each pair, by whole arrays."""
    size = max(map(len, [*a, *b]), default=0)
    x, y = (np.frombuffer("".join(m.ljust(size, ".") for m in s).encode(), np.uint8).reshape(len(s), size) for s in (a, b))
    used = (x != 46) | (y != 46)
    steps = np.zeros(size)
    for k in range(SCALES):
        part = slice(SCALE_STARTS[k], SCALE_STARTS[k + 1])
        steps[part] = (1 << k) / (part.stop - part.start)
    total, agreed = used @ steps, ((x == y) & used) @ steps
    return np.where((x == y).all(axis=1), 1.0, agreed / np.maximum(total, 1e-9))


def near_pairs(prints: DataFrame, least: float = 0.8, bands: int = 96, digits: int = 8, id_col: str = "doc_id") -> DataFrame:
    """(a, b, likeness): verified links that join up all texts that are alike and share a band.

    ``prints``: the id and ``fingerprint``.  A band is ``digits`` sampled places of the
    fingerprint's last full scale but one, where near texts of unlike length still agree.
    Every pair of ``least`` or more that shares a band is a link or has both ends in one
    component of the links, whatever else falls into the band: two rounds verify each text
    against one member of each of its bands, then all members of a band that are still in
    different components are verified, each pair once.  Pairs within a component are not
    made, so a group of near texts costs its size.  Rows of equal fingerprints are linked to
    the smallest id of them, which alone goes on.  Rows with a null id are in no pair.

    By 8 digits a band unrelated texts seldom meet; 96 bands find a pair whose places agree
    in more than a half at least as often as 12 bands of 5 digits.
    """
    named = prints.select(F.col(id_col).cast("bigint").alias("id"), "fingerprint").where("id IS NOT NULL")
    # nodes tell different texts of one id apart
    classes = materialise(named.groupBy("fingerprint").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "classes")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            nodes, keys = [], []
            for node, mark in zip(batch.column("node").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                ends = int(np.searchsorted(SCALE_STARTS, len(mark), "left"))
                for scale in {max(0, ends - 2), max(0, ends - 3)}:  # so that texts about a power of two meet
                    part = mark[SCALE_STARTS[scale] : SCALE_STARTS[scale + 1]].encode()
                    if len(part) not in choices:
                        choices[len(part)] = band_places(len(part), bands, digits)
                    values = np.frombuffer(part, np.uint8)
                    for k, places in enumerate(choices[len(part)]):
                        keys.append(b"%d:%d:" % (scale, k) + values[places].tobytes())
                        nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], ["node", "band"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = likenesses(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "likeness"])

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [classes.select(F.col("node").alias(end), F.col("fingerprint").alias(mark)) for end, mark in (("a", "x"), ("b", "y"))]
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y")
        return materialise(both.mapInArrow(verify, "a bigint, b bigint, likeness double").where(F.col("likeness") >= least), "verified")

    def labelled() -> DataFrame:
        if labels is None:
            return banded.withColumn("component", F.col("node"))
        return banded.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))

    keyed = classes.select("node", "fingerprint").mapInArrow(band, "node bigint, band binary")
    banded = materialise(keyed.select("node", F.xxhash64("band").alias("band")), "bands")
    found = tried = labels = None
    for turn in range(LEADER_ROUNDS):
        rows = labelled()
        # another member leads in each round, the same one in all its bands where it can
        leader = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node"), "node", "component")).alias("l"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        met = rows.join(leader.select("band", "l"), "band").where("component <> l.component")
        pairs = met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        good = verified(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = good if found is None else found.unionByName(good)
        labels = merged(labels, good)
    rows = materialise(labelled(), "labelled")
    each = rows.groupBy("band", "component").agg(F.count("*").alias("size"))
    most = each.groupBy("band").agg(F.max(F.struct("size", "component")).alias("m"), F.count("*").alias("components")).where("components > 1").select("band", F.col("m.component").alias("largest"))
    open_rows = rows.join(most, "band")
    # of a band's texts, those outside its largest component meet all the others
    few = open_rows.where("component <> largest").select("band", F.col("component").alias("c"), F.col("node").alias("q"))
    rest = open_rows.join(few, "band").where("component <> c AND (component = largest OR node < q)")
    pairs = rest.select(F.least("node", "q").alias("a"), F.greatest("node", "q").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    found = found.unionByName(verified(pairs))
    ids = [classes.select(F.col("node").alias(end), F.col("id").alias(f"id_{end}")) for end in ("a", "b")]
    links = found.join(ids[0], "a").join(ids[1], "b").where("id_a <> id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "likeness")
    equal = named.withColumnRenamed("id", "b").join(classes.select("fingerprint", "id"), "fingerprint").where("b <> id")
    return links.unionByName(equal.select(F.col("id").alias("a"), "b", F.lit(1.0).alias("likeness")).distinct())


def with_next(docs: DataFrame, id_col: str, text: str, parts: int) -> DataFrame:
    """Rows in shards of ascending id, and after each shard the first row of the next one.

    (shard, place, doc_id, text): place 0 are the shard's own rows, 1 is its guest, 2 the very
    first row, which follows the last.  What the driver sees is one id for each shard.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    bounds = range_bounds(rows, "doc_id", parts)
    sharded = rows.withColumn("shard", shard_of(F.col("doc_id"), bounds))
    firsts = sharded.groupBy("shard").agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).orderBy("shard").collect()
    shards = [r["shard"] for r in firsts]
    first = {r["shard"]: None if r["nulls"] else r["first"] for r in firsts}
    guests = [(first[s], shards[i - 1] if i else shards[-1], 1 if i else 2) for i, s in enumerate(shards)]
    copies = docs.sparkSession.createDataFrame(guests, "doc_id bigint, shard int, place int")
    own = sharded.withColumn("place", F.lit(0))
    guest = rows.join(F.broadcast(copies.withColumnRenamed("doc_id", "g")), F.col("doc_id").eqNullSafe(F.col("g"))).select("doc_id", "text", "shard", "place")
    return own.unionByName(guest).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "place", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of texts and of their edited texts: the last quarter replaced by the start of the next.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    Rows of equal id follow each other by text; an only row follows itself.
    """
    ordered = with_next(docs, id_col, text, parts or shuffle_partitions(docs.sparkSession))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for place, doc_id, body in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "text")), strict=True):
                yield place, doc_id, body or ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple] = []
        held = 0
        followed = False
        for row in rows_of(batches):
            lot.append(row)
            held += len(row[2])
            if row[0]:
                followed = True
                break  # the least of the rows that follow
            if held > TOGETHER and len(lot) > 1:
                yield made(lot)
                lot, held = lot[-1:], len(row[2])
        if lot and (followed and len(lot) > 1):
            yield made(lot)
        for _ in batches:
            pass

    def made(lot: list[tuple]) -> pa.RecordBatch:
        """Of all rows but the last, which is only followed."""
        texts = [t for _, _, t in lot]
        edited = []
        for t, after in zip(texts, texts[1:], strict=False):
            quarter = len(t) // 4
            edited.append(t[: len(t) - quarter] + after[:quarter])
        prints = fingerprints(texts)
        changed = fingerprints(edited)
        columns = [
            [d for _, d, _ in lot[:-1]],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            prints[:-1],
            changed,
            [likeness(a, b) for a, b in zip(prints, changed, strict=False)],
            [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return ordered.mapInArrow(work, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Whole table: fingerprints of every text and of its edited text."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
