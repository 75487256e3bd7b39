"""Keeping an index up to date: snapshot differences, cascading deletes, merges of several indices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.storage import persisted
from loregraph.operators.graph import Index, deduplicate_edges, load_graph
from loregraph.schema import QueryError

UNCHANGED, ADDED, MODIFIED, DELETED = "unchanged", "A", "M", "D"


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id", hashed: str = "source_hash") -> DataFrame:
    """(key, status): added, modified, deleted or unchanged by hash.  A renamed document is a delete and an add.

    Null hashes equal each other; keys should be distinct and not null.
    """
    before = old.select(key, F.col(hashed).alias("_old"), F.lit(True).alias("_was"))
    after = new.select(key, F.col(hashed).alias("_new"), F.lit(True).alias("_is"))
    status = F.when(F.col("_was").isNull(), ADDED).when(F.col("_is").isNull(), DELETED).when(F.col("_old").eqNullSafe(F.col("_new")), UNCHANGED).otherwise(MODIFIED)
    return before.join(after, key, "full_outer").select(key, status.alias("status"))


def document_id(node: Column) -> Column:
    """The part of a node's id after its prefix: the id of its document."""
    return F.when(F.contains(node, F.lit(":")), F.regexp_replace(node, "^[^:]*:", "")).otherwise(node)


def remove_edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges without those at the nodes ``ids(id)``."""
    for side in ("from_node", "to_node"):
        edges = edges.join(ids.select(F.col("id").alias(side)), side, "left_anti").select(*edges.columns)
    return edges


def cascade_delete(index: Index, ids: DataFrame) -> Index:
    """The index without the nodes ``ids(id)``, their edges both ways and their chunks."""
    nodes = index.nodes.join(ids.select("id"), "id", "left_anti").select(*index.nodes.columns)
    chunks = index.embeddings
    if chunks is not None:
        gone = index.nodes.join(ids.select("id"), "id", "left_semi").select(document_id(F.col("id")).alias("document_id")).distinct()
        chunks = chunks.join(gone, "document_id", "left_anti").select(*chunks.columns)
    return Index(nodes, remove_edges_of(index.edges, ids), remove_edges_of(index.orphans, ids), chunks, index.manifest)


def apply_diff(index: Index, changed: Index, diff: DataFrame, encode: Callable[[Column], Column] | None = None) -> Index:
    """Changed and deleted documents leave; the rows of added and changed ones in ``changed`` come in.

    With ``encode``, a function of a text column, chunks in ``changed`` take over the vectors of
    stored ones with the same text, wherever they were, and only new texts are encoded.

    Edges that start elsewhere and end at a changed node stay: only its own are made anew.
    Orphans get another look, as their ends may be there now.
    """
    leaving = diff.where(F.col("status").isin(MODIFIED, DELETED)).select("id")
    nodes = index.nodes.join(leaving, "id", "left_anti").select(*index.nodes.columns).unionByName(changed.nodes, allowMissingColumns=True)
    columns = index.edges.columns
    known = index.edges.unionByName(index.orphans.select(*columns))
    kept = known.join(leaving.withColumnRenamed("id", "from_node"), "from_node", "left_anti").select(*columns)
    edges = kept.unionByName(changed.edges.select(*columns)).unionByName(changed.orphans.select(*columns))
    chunks = index.embeddings
    if chunks is not None:
        gone = leaving.select(document_id(F.col("id")).alias("document_id")).distinct()
        chunks = chunks.join(gone, "document_id", "left_anti").select(*chunks.columns)
        if changed.embeddings is not None:
            made = changed.embeddings if encode is None else with_vectors(changed.embeddings, index.embeddings, encode)
            chunks = chunks.unionByName(made, allowMissingColumns=True)
    return load_graph(nodes, edges, chunks, index.manifest)


def text_key(text: str = "context_text") -> Column:
    """What tells texts to encode apart."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def chunk_changes(stored: DataFrame, made: DataFrame, text: str = "context_text") -> DataFrame:
    """(id, status) of chunks: unchanged, moved (its text was stored under another id), new, and deleted (stored, and no more under this id with any text).

    Ids should be distinct in each table.  A changed chunk is new or moved, by its text.
    """
    before = stored.select("id", text_key(text).alias("_old"), F.lit(True).alias("_was"))
    after = made.select("id", text_key(text).alias("_new"), F.lit(True).alias("_is"))
    texts = before.select(F.col("_old").alias("_new"), F.lit(True).alias("_known")).distinct()
    both = before.join(after, "id", "full_outer").join(texts, "_new", "left")
    status = F.when(F.col("_is").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").when(F.col("_known"), "moved").otherwise("new")
    return both.select("id", status.alias("status"))


def with_vectors(made: DataFrame, stored: DataFrame, encode: Callable[[Column], Column], text: str = "context_text") -> DataFrame:
    """``made`` with ``vector``: of a stored chunk with the same text, else encoded, each new text once."""
    keyed = made.drop("vector").withColumn("_key", text_key(text))
    # chunks of one text have one vector
    old = stored.where("vector IS NOT NULL").groupBy(text_key(text).alias("_key")).agg(F.min("vector").alias("_stored"))
    fresh = keyed.join(old.select("_key"), "_key", "left_anti").groupBy("_key").agg(F.min(text).alias("_text"))
    fresh = persisted(fresh.select("_key", encode(F.col("_text")).alias("_fresh")), "encoded")
    found = keyed.join(old, "_key", "left").join(fresh, "_key", "left")
    return found.select(*made.drop("vector").columns, F.coalesce("_stored", "_fresh").alias("vector"))


def stale_chunks(stored: DataFrame, made: DataFrame) -> DataFrame:
    """Ids of stored chunks whose text has another hash now, or which are no more."""
    now = made.select("id", F.col("text_hash").alias("_now"))
    return stored.join(now, "id", "left").where(~F.col("text_hash").eqNullSafe(F.col("_now"))).select("id")


# --- merging -----------------------------------------------------------------------------


def check_manifests(manifests: DataFrame) -> None:
    """An error unless at least two sources agree on major version, structure and (with vectors) model."""
    with_vectors = F.when(F.col("index_level") != "L1", F.col("embedding_model"))
    row = manifests.agg(
        F.count("*").alias("n"),
        F.count_distinct(F.substring_index("version", ".", 1)).alias("versions"),
        F.count_distinct(with_vectors).alias("models"),
        F.count_distinct("structure").alias("structures"),
    ).first()
    if row["n"] < 2:
        raise QueryError("INSUFFICIENT_SOURCES", "a merge has at least two sources")
    for count, code in (("versions", "INCOMPATIBLE_VERSION"), ("models", "INCOMPATIBLE_EMBEDDING_MODEL"), ("structures", "INCOMPATIBLE_STRUCTURE")):
        if row[count] > 1:
            raise QueryError(code, f"the sources have {row[count]} {count}")


def merge_nodes(nodes: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Of ``nodes`` with a ``source`` one row per id, the last indexed (then the greatest source), with ``conflict``.

    A conflict is more than one hash.  Ids in ``tombstones(node_id)`` are gone, whatever others
    say.  Nulls of ``indexed_at`` come first.  Aggregates combine before the shuffle.
    """
    if tombstones is not None:
        nodes = nodes.join(tombstones.select(F.col("node_id").alias("id")), "id", "left_anti").select(*nodes.columns)
    rest = [c for c in nodes.columns if c != "id"]
    order = F.struct(F.col("indexed_at").isNotNull(), "indexed_at", "source")
    low, high = F.min("source_hash"), F.max("source_hash")
    kept = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_row"), (low != high).alias("_differs"))
    return kept.select("id", *[F.col(f"_row.{c}").alias(c) for c in rest], F.coalesce("_differs", F.lit(False)).alias("conflict"))


def merge_edges(edges: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Each triple of the sources' edges once, without those at deleted nodes."""
    kept = deduplicate_edges(edges)
    return kept if tombstones is None else remove_edges_of(kept, tombstones.select(F.col("node_id").alias("id")))


def merge_indices(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None, manifests: DataFrame, tombstones: DataFrame | None = None, fail_on_conflict: bool = False) -> tuple[Index, DataFrame]:
    """(index, metrics) of several indices whose rows carry a ``source``; chunks are those of the winning source."""
    check_manifests(manifests)
    merged = merge_nodes(nodes, tombstones)
    if fail_on_conflict and not merged.where("conflict").isEmpty():
        raise QueryError("MERGE_CONFLICT", "the sources have different versions of a node")
    chunks = None
    if embeddings is not None:
        winners = merged.select(document_id(F.col("id")).alias("document_id"), "source").distinct()
        chunks = embeddings.join(winners, ["document_id", "source"], "left_semi").select(*embeddings.columns)
    metrics = merged.agg(F.count("*").alias("total_nodes"), F.count_if("conflict").alias("conflicts_resolved"))
    metrics = metrics.join(manifests.agg(F.count("*").alias("source_count")))  # one row each
    return load_graph(merged.drop("conflict"), merge_edges(edges, tombstones), chunks), metrics
