"""Access labels: what a reader may not see is gone before scores, walks and counts.

A node with labels (array column ``access``) is visible to a reader who has one of them; a node
without labels to all.  ``restricted`` gives the index as if hidden nodes had never been in it:
their edges, chunks and orphan edges go too, and no walk passes them, so that no distance, count
or path tells of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.storage import later
from loregraph.operators.graph import Index, Steps
from loregraph.operators.vector import nodes_of_documents


def is_visible(allowed: list[str], labels: str = "access") -> Column:
    own = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    return (F.size(own) == 0) | F.arrays_overlap(own, F.array(*[F.lit(a) for a in allowed]).cast("array<string>"))


@dataclass
class VisibleSteps:
    """The steps of a graph that don't end at one of ``hidden(id)``; walks that start at visible nodes stay among them."""

    steps: Steps
    hidden: DataFrame

    def step(self, frontier: DataFrame, side: str, edge_types: list[str] | None = None, respect_layers: bool = False) -> DataFrame:
        found = self.steps.step(frontier, side, edge_types, respect_layers)
        return found.join(self.hidden.select(F.col("id").alias("next")), "next", "left_anti").select(*found.columns)

    def both(self, frontier: DataFrame, edge_types: list[str] | None = None, respect_layers: bool = False) -> DataFrame:
        return self.step(frontier, "out", edge_types, respect_layers).unionByName(self.step(frontier, "back", edge_types, respect_layers))


def without_ends(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    for end in ("from_node", "to_node"):
        edges = edges.join(hidden.select(F.col("id").alias(end)), end, "left_anti").select(*edges.columns)
    return edges


def restricted(index: Index, allowed: list[str], labels: str = "access") -> Index:
    """The index as a reader with the labels ``allowed`` sees it.

    Vectors are searched exactly, as a shortlist by codes would be cut with hidden ones in it.
    """
    visible = index.nodes.where(is_visible(allowed, labels))
    hidden = index.nodes.where(~is_visible(allowed, labels)).select("id")
    chunks = index.embeddings
    if chunks is not None:
        own = nodes_of_documents(chunks.select("document_id"), index.nodes).join(hidden.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
        chunks = chunks.join(own.select("document_id"), "document_id", "left_anti").select(*chunks.columns)
    return replace(
        index, nodes=visible, edges=later(index.edges, lambda e: without_ends(e, hidden)), orphans=later(index.orphans, lambda e: without_ends(e, hidden)), embeddings=chunks,
        adjacency=None if index.adjacency is None else VisibleSteps(index.adjacency, hidden), texts=None if index.texts is None else later(index.texts, lambda t: replace(t, nodes=visible)), near=None,
    )
