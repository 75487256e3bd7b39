"""N-gram Jaccard join (operator 2): rare-first prefix filtering over word shingles.

1. *Counts.* A task hashes its texts' shingles and deals them, packed, into ranges of the
   hash.  A pack has a range's shingles of one *packet*, some million shingles of documents
   that follow each other, and tells which document of the packet each is of.  A range's
   task counts all its shingles and sends back, to each packet, those that two or more
   documents have, with their counts.  So rows are packets times ranges, whatever the number
   of documents, and the texts are read once.
2. *Prefixes.* Shingles are ordered rare first.  Those of one document alone come before all
   others and match nothing.  A set whose shared shingles are fewer than the threshold asks
   of any partner is done.  Of the rest, each set's prefix of n - ceil(t n) + 1 shingles,
   without its own ones, is posted under its shingles.  Documents with equal sets are one
   set from here on.
3. *Links.* Candidates share a posted shingle and pass the length filter, the positional
   filter (what is left after the shared shingle) and the suffix filter (how the shingles
   fall into hash classes bounds the overlap).  Every candidate pair is verified once, by
   the exact overlap.  ``LEADER_ROUNDS`` rounds first verify each set against one leader of
   its postings; then the candidates whose ends are in different components are verified,
   whatever their number, dealt by shingle and length.  A pair within a component can't
   change the components and is not made, so a group of near copies costs its size and not
   its square.

Shingles are 64-bit hashes of whole words.  In the join a shingle is its range and 40 more
bits, so the chance that two of a pair's differing shingles are mistaken for each other is
about 10**-8 for texts of 500 words; sets are told apart by 128 bits.

Packets are told apart by the place of their first row in the input.  A packet whose parts
don't add up, because a task that ran again got its rows in another order, is an error and
not a loss: such an input (one that a shuffle made) is to be written as a table first.

Defined results: a text without words, empty or null, has an empty set and links with
nothing, itself excepted; texts with fewer words than a shingle have one shingle of all
their words; rows with equal texts are linked; a null id is passed over where the smallest
id of a component is taken, unless there is no other; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import discard, materialise, returning_memory, shuffle_partitions
from loregraph.llm.components import merged
from loregraph.llm.shingles import set_key, shingle_sets

#: Shingles that a packet holds, and documents at most.
HELD = 1 << 20
MOST_DOCS = 60_000
#: Hash classes of the suffix filter.
CLASSES = 8
#: Counts are told apart up to this: enough for an order that is the same for all sets.
MOST_COUNT = 65_535
HEAD = ("ids", "has_id", "keys", "sizes", "stay")
PACK = "packet bigint, mark bigint, range int, owners binary, low binary, more binary, again_low binary, again_more binary, again binary"
ANSWER = f"{PACK}, whole int, counts binary, totals binary"
HEADS = ", ".join(f"{c} binary" for c in HEAD)


def packed_owners(owners: np.ndarray) -> bytes:
    """Ascending numbers as steps of one or two bytes; how many follows from the length."""
    steps = np.diff(owners, prepend=0)
    return steps.astype(np.uint8 if not len(steps) or steps.max() < 256 else "<u2").tobytes()


def unpacked_owners(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8 if len(data) == count else "<u2"), dtype=np.int64)


def packs_of(rows: DataFrame, width: int, ranges: int) -> DataFrame:
    """Packets of ``rows(doc_id, text)``, a row for each range of the shingles' hash.

    A shingle that one document of the packet has stands with its document (``owners``, ``low``,
    ``more``); one that several have stands once, with how many (``again_low``, ``again_more``,
    ``again``).  Whose these are stays with the packet's head, which a range chosen by the packet
    passes on: a shingle of all documents costs its range an entry a packet.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        sets: list[np.ndarray] = []
        for batch in batches:
            names = batch.column("doc_id")
            for at, hashes in shingle_sets(batch.column("text"), width):
                ids.append(names[at].as_py())
                sets.append(hashes)
                held += len(hashes)
                if held >= HELD or len(sets) >= MOST_DOCS:
                    yield dealt(part, number, ids, sets)
                    ids, sets, held, number = [], [], 0, number + 1
        if sets:
            yield dealt(part, number, ids, sets)

    def dealt(part: int, number: int, ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        head = (
            np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(),
            b"".join(set_key(s) for s in sets), sizes.astype("<u4").tobytes(),
        )
        mark = int.from_bytes(hashlib.blake2b(b"".join(head), digest_size=8).digest(), "little", signed=True)
        hashes = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        at = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        # the range is a function of the upper 32 bits; 8 of the rest of them tell more
        tokens = at << np.uint64(40) | hashes & np.uint64((1 << 40) - 1)
        del hashes, at
        order = np.argsort(tokens)
        ahead = tokens[order]
        same = ahead[1:] == ahead[:-1]
        several = np.append(False, same) | np.append(same, False) if len(ahead) else np.zeros(0, bool)
        again, counts = np.unique(ahead[several], return_counts=True)
        single = np.ones(len(tokens), bool)
        single[order[several]] = False
        stay = owners[order[several]].astype("<u2").tobytes()
        del order, ahead, same, several
        tokens, owners = tokens[single], owners[single]
        at = (tokens >> np.uint64(40)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
        order = np.argsort(at, kind="stable")  # within a range by document
        bounds = np.arange(ranges + 1, dtype=np.uint64)
        cuts = np.searchsorted(at[order], np.arange(ranges + 1))
        more_cuts = np.searchsorted(again >> np.uint64(40), bounds)
        tokens, owners = tokens[order], owners[order].astype(np.int64)
        bears = (part + number) % ranges  # heads are spread over the ranges
        rows = []
        for r in range(ranges):
            one, more = slice(cuts[r], cuts[r + 1]), slice(more_cuts[r], more_cuts[r + 1])
            if cuts[r] < cuts[r + 1] or more_cuts[r] < more_cuts[r + 1] or r == bears:
                parts = (packed_owners(owners[one]), *split_tokens(tokens[one]), *split_tokens(again[more]), counts[more].astype("<u2").tobytes())
                rows.append((part << 24 | number, mark, r, *parts, *((*head, stay) if r == bears else (None,) * len(HEAD))))
        return batch_of(rows, f"{PACK}, {HEADS}")

    return rows.mapInArrow(returning_memory(deal), f"{PACK}, {HEADS}")


def split_tokens(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """The low 32 and the next 8 bits."""
    return tokens.astype("<u4").tobytes(), (tokens >> np.uint64(32)).astype(np.uint8).tobytes()


def joined_tokens(low: bytes, more: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(more, np.uint8).astype(np.uint64) << np.uint64(32)


def shingle_profiles(docs: DataFrame, width: int, percent: int, id_col: str, text: str, ranges: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, weight, tokens) of every row.

    ``tokens``: the shingles that other documents have too, rare first, if they are as many as
    a partner at ``percent`` needs; else none.  ``weight``: how many documents have a shingle,
    on average.  The key is null for an empty set.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for part in batch.to_pylist():
                if part["range"] != now and parts:
                    yield from counted(parts)
                    parts = []
                now = part["range"]
                parts.append(part)
        if parts:
            yield from counted(parts)

    def counted(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        pieces = [t for p in parts for t in (joined_tokens(p["low"], p["more"]), joined_tokens(p["again_low"], p["again_more"]))]
        times = [t for p in parts for t in (np.ones(len(p["more"]), np.int64), np.frombuffer(p["again"], "<u2").astype(np.int64))]
        tokens, times = np.concatenate(pieces), np.concatenate(times)
        del pieces
        order = np.argsort(tokens)
        ahead = tokens[order]
        first = np.flatnonzero(np.append(True, ahead[1:] != ahead[:-1])) if len(ahead) else np.zeros(0, np.int64)
        runs = np.diff(first, append=len(ahead))
        sums = np.add.reduceat(times[order], first) if len(ahead) else np.zeros(0, np.int64)
        counts = np.empty(len(tokens), "<u2")
        counts[order] = np.repeat(np.minimum(sums, MOST_COUNT).astype("<u2"), runs)
        del order, ahead, times
        rows, held, at = [], 0, 0
        for p in parts:
            ones, several = len(p["more"]), len(p["again_more"])
            here, after = slice(at, at + ones), slice(at + ones, at + ones + several)
            at += ones + several
            shared = counts[here] > 1
            own = unpacked_owners(p["owners"], ones)[shared]
            kept = tokens[here][shared]
            whole = ones + int(np.frombuffer(p["again"], "<u2").sum(dtype=np.int64))
            rows.append((p["packet"], p["mark"], p["range"], packed_owners(own), *split_tokens(kept), p["again_low"], p["again_more"], p["again"], whole, counts[here][shared].tobytes(), counts[after].tobytes(), *(p[c] for c in HEAD)))
            held += len(kept) + several
            if held >= HELD:
                yield batch_of(rows, f"{ANSWER}, {HEADS}")
                rows, held = [], 0
        if rows:
            yield batch_of(rows, f"{ANSWER}, {HEADS}")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for part in batch.to_pylist():
                if part["packet"] != now and parts:
                    yield from gathered(parts)
                    parts = []
                now = part["packet"]
                parts.append(part)
        if parts:
            yield from gathered(parts)

    def gathered(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        heads = [p for p in parts if p["sizes"] is not None]
        sizes = np.frombuffer(heads[0]["sizes"], "<u4").astype(np.int64) if heads else np.zeros(0, np.int64)
        if len(heads) != 1 or len({p["mark"] for p in parts}) > 1 or sum(p["whole"] for p in parts) != sizes.sum():
            raise RuntimeError("the input's rows came in another order when a task ran again: write it as a table first")
        head = heads[0]
        parts.sort(key=lambda p: p["range"])  # as the owners that stayed are
        keys = np.frombuffer(head["keys"], "V16")
        ids = pa.array(np.frombuffer(head["ids"], "<i8"), pa.int64(), mask=np.frombuffer(head["has_id"], np.uint8) == 0)
        named = lambda p, low, more: joined_tokens(p[low], p[more]).astype(np.int64) | p["range"] << 40
        times = np.concatenate([np.frombuffer(p["again"], "<u2") for p in parts])
        owners = np.concatenate([*[unpacked_owners(p["owners"], len(p["more"])) for p in parts], np.frombuffer(head["stay"], "<u2").astype(np.int64)])
        tokens = np.concatenate([*[named(p, "low", "more") for p in parts], np.repeat(np.concatenate([named(p, "again_low", "again_more") for p in parts]), times)])
        counts = np.concatenate([*[np.frombuffer(p["counts"], "<u2") for p in parts], np.repeat(np.concatenate([np.frombuffer(p["totals"], "<u2") for p in parts]), times)])
        shared = np.bincount(owners, minlength=len(sizes))
        weights = np.bincount(owners, counts, minlength=len(sizes)) / np.maximum(sizes, 1)
        enough = (shared * 100 >= sizes * percent) & (sizes > 0)
        kept = enough[owners]
        owners, tokens, counts = owners[kept], tokens[kept], counts[kept]
        order = np.lexsort((tokens, counts, owners))
        tokens = tokens[order]
        offsets = np.append(0, np.cumsum(np.where(enough, shared, 0)))
        for at in range(0, len(sizes), 4096):
            upto = min(at + 4096, len(sizes))
            lists = pa.ListArray.from_arrays(pa.array(offsets[at : upto + 1] - offsets[at], pa.int32()), pa.array(tokens[offsets[at] : offsets[upto]]))
            set_keys = pa.array([keys[i].tobytes() if sizes[i] else None for i in range(at, upto)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids[at:upto], pa.array(sizes[at:upto]), set_keys, pa.array(weights[at:upto]), lists], ["doc_id", "n_shingles", "set_key", "weight", "tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    packs = packs_of(rows, width, ranges).repartitionById(ranges, F.col("range"))
    answers = packs.mapInArrow(returning_memory(count), f"{ANSWER}, {HEADS}").repartition(ranges, "packet").sortWithinPartitions("packet")
    return answers.mapInArrow(returning_memory(gather), "doc_id bigint, n_shingles bigint, set_key binary, weight double, tokens array<bigint>")


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)], [c for c, _ in columns])


def postings(profiles: DataFrame, t: int) -> DataFrame:
    """(token, p) of the prefixes of all sets that can have a partner; p: weight, key, n, at, classes."""
    classes = F.array(*[F.expr(f"size(filter(tokens, x -> (x & {CLASSES - 1}) = {c}))") for c in range(CLASSES)])
    prefix = F.expr(f"greatest(0, n - (n * {t} + 99) div 100 + 1 - (n - size(tokens)))").cast("int")
    # computed below the generator, so that its rows don't carry the whole array
    prefixes = profiles.select("set_key", "n", "weight", (F.col("n") - F.size("tokens")).alias("own"), classes.alias("classes"), F.slice("tokens", 1, prefix).alias("prefix"))
    posted = prefixes.select("set_key", "n", "weight", "own", "classes", F.posexplode("prefix").alias("at", "token"))
    return posted.select("token", F.struct("weight", F.col("set_key").alias("key"), "n", (F.col("at") + F.col("own")).alias("at"), "classes").alias("p"))


def passes(a: str, b: str, t: int):
    """Length, positional and suffix filters for two postings of one shingle."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = F.ceil((n_a + n_b) * t / (100.0 + t) - 1e-6)
    length = (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * t)
    left = F.least(n_a - F.col(f"{a}.at"), n_b - F.col(f"{b}.at"))
    overlap = sum((F.least(F.get(F.col(f"{a}.classes"), c), F.get(F.col(f"{b}.classes"), c)) for c in range(1, CLASSES)), F.least(F.get(F.col(f"{a}.classes"), 0), F.get(F.col(f"{b}.classes"), 0)))
    return length & (left >= least) & (overlap >= least)


def length_band(n, t: int):
    """A number for sets of about ``n`` shingles: those of a pair that passes the length filter differ by 1 at most."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / t) + 1e-9).cast("int") if t < 100 else n.cast("int")


def verified(pairs: DataFrame, profiles: DataFrame, t: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose sets reach the threshold, by the exact overlap."""
    left = profiles.select(F.col("set_key").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    right = profiles.select(F.col("set_key").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(overlap * (100 + t) >= (F.col("n_a") + F.col("n_b")) * t).select("a", "b", overlap.alias("overlap"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``percent``: least Jaccard similarity of a link."""
    rows = profiles_of(docs, width, percent, id_col, text)
    links, labels = set_links(rows, percent)
    discard(*links)
    return component_ids(rows.select("doc_id", "n_shingles", "set_key"), labels)


def component_ids(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``sets(doc_id, n_shingles, set_key)``, whose linked sets ``labels`` names."""
    by_set = sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    linked = by_set.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "least", F.coalesce("component", "set_key").alias("component"))
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "component").select("set_key", "component_id")
    return sets.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: Rounds in which each set meets one leader, before the rest of the candidates is verified.
LEADER_ROUNDS = 2


def profiles_of(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``shingle_profiles``, written to the shared folder."""
    return materialise(shingle_profiles(docs, width, percent, id_col, text, shuffle_partitions(docs.sparkSession)), "profiles")


def set_links(rows: DataFrame, percent: int = 80) -> tuple[list[DataFrame], DataFrame]:
    """(links, labels) of the different shingle sets of ``rows``, which ``profiles_of`` made.

    ``links(a, b, overlap)``, a table a round, are verified and join up all components: every
    pair at or above ``percent`` is one or has both ends in one component.  ``labels(node,
    component)`` names the components of all sets that have a link.
    """
    t = percent
    able = rows.where(F.size("tokens") > 0).select("set_key", F.col("n_shingles").alias("n"), "weight", "tokens")
    # a set whose shingles many others have is in the middle of its group: it leads
    profiles = materialise(able.dropDuplicates(["set_key"]), "sets")
    return links_of(profiles, materialise(postings(profiles, t), "postings"), t)


def links_of(profiles: DataFrame, posted: DataFrame, t: int, passes: Callable = passes, join_up: Callable = merged, share: Callable | None = None) -> tuple[list[DataFrame], DataFrame]:
    """(links, labels) of the sets of ``profiles(set_key, n, tokens)``, whose candidates share a token of ``posted(token, p)``.

    ``p`` is a struct of weight, key, n and what ``passes(a, b, t)``, the filter of two
    postings, looks at; ``join_up`` adds links to labels.  Where ``share`` is given, a round's leaders are
    those of the postings for which ``share(round)`` holds.  Both written tables are deleted.
    """
    found: list[DataFrame] = []
    tried = labels = None
    for number in range(LEADER_ROUNDS):
        labelled = _labelled(posted.where(share(number)) if share else posted, labels)
        leader = labelled.groupBy("token").agg(F.max(F.struct("p", "component")).alias("l"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        met = labelled.join(leader.select("token", F.col("l.p").alias("l"), F.col("l.component").alias("of")), "token")
        met = met.where((F.col("component") != F.col("of")) & passes("p", "l", t))
        ends = met.select(F.col("p.key").alias("k"), F.struct("l.weight", "l.key").alias("l"), F.least("p.key", "l.key").alias("a"), F.greatest("p.key", "l.key").alias("b"))
        if tried is not None:
            ends = ends.join(tried, ["a", "b"], "left_anti")
        # the foremost of its leaders, which is the same one for most of a group
        pairs = materialise(ends.groupBy("k").agg(F.max("l").alias("l")).select(F.least("k", "l.key").alias("a"), F.greatest("k", "l.key").alias("b")).distinct(), "pairs")
        found.append(materialise(verified(pairs, profiles, t), "verified"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = join_up(labels, found[-1])
    labelled = materialise(_labelled(posted, labels), "labelled")
    discard(posted)
    rest = open_pairs(labelled, t, passes).join(tried, ["a", "b"], "left_anti")
    found.append(materialise(verified(rest, profiles, t), "verified"))
    discard(labelled, profiles)
    return found, join_up(labels, found[-1])


def open_pairs(labelled: DataFrame, t: int, passes: Callable = passes) -> DataFrame:
    """(a, b): each pair of postings of one shingle that passes the filters and is in different components.

    Dealt by shingle and by length, as partners are about equally long: so the postings of a
    very frequent shingle are parted too.  Of these, those outside the largest component meet
    the others.
    """
    each = labelled.groupBy("token", "component").agg(F.count("*").alias("size"))
    most = each.groupBy("token").agg(F.max(F.struct("size", "component")).alias("m"), F.count("*").alias("components")).where("components > 1").select("token", F.col("m.component").alias("largest"))
    rows = labelled.join(most, "token").withColumn("band", length_band(F.col("p.n"), t))
    near = F.array(*[F.col("band") + d for d in (-1, 0, 1)])
    few = rows.where("component <> largest").select("token", F.explode(near).alias("band"), F.col("component").alias("c"), F.col("p").alias("q"))
    once = (F.col("component") == F.col("largest")) | (F.col("p.key") < F.col("q.key"))
    met = rows.join(few, ["token", "band"]).where((F.col("component") != F.col("c")) & once & passes("p", "q", t))
    return met.select(F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b")).distinct()


def _labelled(posted: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posted.withColumn("component", F.col("p.key"))
    named = labels.select(F.col("node").alias("key"), F.col("component").alias("label"))
    return posted.withColumn("key", F.col("p.key")).join(named, "key", "left").select("token", "p", F.coalesce("label", "key").alias("component"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Whole table: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
