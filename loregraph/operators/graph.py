"""Graph operators: loading with orphans set aside, incident edges, bounded traversals.

The graph is two tables.  Traversals loop over levels on the driver; a level is joins of ids
alone and is written to the shared folder, so neither the plan nor a task grows with depth.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregraph.functions.storage import discard, persisted
from loregraph.operators.cells import CellIndex
from loregraph.operators.substring import TextIndex

EDGE_KEY = ["from_node", "to_node", "edge_type"]


@dataclass
class Index:
    """An index: nodes, loaded edges (each triple once, both ends there), orphans, embeddings."""

    nodes: DataFrame
    edges: DataFrame
    orphans: DataFrame
    embeddings: DataFrame | None = None
    manifest: DataFrame | None = None
    adjacency: Steps | None = None
    texts: TextIndex | None = None
    near: CellIndex | None = None

    def walkable(self) -> Index:
        """The same index with edges to walk on: the stored adjacency, or all edges written once."""
        if self.adjacency is not None:
            return self
        edges = persisted(self.edges, "edges")
        return replace(self, edges=edges, adjacency=EdgeTable(edges))


class Steps(Protocol):
    """What walks ask of a graph: the edges at the nodes of a frontier."""

    def step(self, frontier: DataFrame, side: str, edge_types: list[str] | None = None, respect_layers: bool = False) -> DataFrame:
        """Each row of ``frontier(id, ...)`` with the edges out of its node, or ``back`` into it, and ``next``, their other end."""

    def both(self, frontier: DataFrame, edge_types: list[str] | None = None, respect_layers: bool = False) -> DataFrame: ...


@dataclass
class EdgeTable:
    """Steps by a join with a plain table of edges."""

    table: DataFrame

    def step(self, frontier: DataFrame, side: str, edge_types: list[str] | None = None, respect_layers: bool = False) -> DataFrame:
        own, other = ("from_node", "to_node") if side == "out" else ("to_node", "from_node")
        edges = followed(self.table, edge_types, respect_layers)
        return frontier.join(edges.withColumn("id", F.col(own)), "id").withColumn("next", F.col(other))

    def both(self, frontier: DataFrame, edge_types: list[str] | None = None, respect_layers: bool = False) -> DataFrame:
        return self.step(frontier, "out", edge_types, respect_layers).unionByName(self.step(frontier, "back", edge_types, respect_layers))


def steps_of(edges: DataFrame | Steps) -> Steps:
    return EdgeTable(edges) if isinstance(edges, DataFrame) else edges


def deduplicate_edges(edges: DataFrame) -> DataFrame:
    """Of equal (from, to, type) the one with the smallest ``edge_seq``."""
    rest = [c for c in edges.columns if c not in (*EDGE_KEY, "edge_seq")]
    kept = edges.groupBy(*EDGE_KEY).agg(F.min("edge_seq").alias("edge_seq"), *([F.min_by(F.struct(*rest), "edge_seq").alias("rest")] if rest else []))
    return kept.select(*[F.col(c) if c in (*EDGE_KEY, "edge_seq") else F.col(f"rest.{c}").alias(c) for c in edges.columns])


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with ``from_exists`` and ``to_exists``."""
    ids = nodes.select("id").distinct()
    ends = edges.join(ids.select(F.col("id").alias("from_node"), F.lit(True).alias("from_exists")), "from_node", "left")
    ends = ends.join(ids.select(F.col("id").alias("to_node"), F.lit(True).alias("to_exists")), "to_node", "left")
    return ends.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("from_exists", "to_exists")})


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: the last indexed, of equal times the one of the greatest file and hash."""
    rest = [c for c in nodes.columns if c != "id"]
    order = [F.col(c) for c in ("indexed_at", "source_file", "source_hash", "kind") if c in rest]
    kept = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(F.lit(0), *[x for c in order for x in (c.isNotNull(), c)])).alias("row"))
    return kept.select(*[F.col("id") if c == "id" else F.col(f"row.{c}").alias(c) for c in nodes.columns])


def load_graph(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None, manifest: DataFrame | None = None) -> Index:
    """Set orphans aside (duplicates too), keep each other triple once, and one node of an id."""
    ends = with_ends(nodes, edges)
    whole = F.col("from_exists") & F.col("to_exists")
    # copies go before the ends are looked up
    ids = nodes.select("id").distinct()
    loaded = deduplicate_edges(edges)
    for end in ("from_node", "to_node"):
        loaded = loaded.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    loaded = loaded.select(*edges.columns)
    reason = F.when(~F.col("from_exists") & ~F.col("to_exists"), "both_missing").when(F.col("from_exists"), "missing_target").otherwise("missing_source")
    orphans = ends.where(~whole).withColumn("reason", reason)
    return Index(latest_nodes(nodes), loaded, orphans, embeddings, manifest)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows replace those of their ids."""
    return nodes.join(new.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(new.select(*nodes.columns))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> Index:
    """Load again with more edges, which come after those that are there."""
    return load_graph(nodes, edges.unionByName(new))


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("to_node") == node)


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("from_node") == node)


def followed(edges: DataFrame, edge_types: list[str] | None = None, respect_layers: bool = True) -> DataFrame:
    """Edges of the types (all if none are named), without layer violations if these are respected."""
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    return edges.where(~F.col("layer_violation")) if respect_layers else edges


def reach(edges: DataFrame | Steps, roots: DataFrame, depth: int, edge_types: list[str] | None = None, respect_layers: bool = True) -> DataFrame:
    """(seed, id, dist) of what lies within ``depth`` of every row of ``roots(seed, id)``, breadth first in both directions.

    One seed's walk doesn't depend on the others'.  Levels are deleted once what they reached
    is written.
    """
    graph = steps_of(edges)
    levels = [persisted(roots.select("seed", "id").distinct().withColumn("dist", F.lit(0)), "level")]
    reached = levels[0]
    for level in range(1, depth + 1):
        found = graph.both(levels[-1].select("seed", "id"), edge_types, respect_layers).select("seed", F.col("next").alias("id")).distinct()
        fresh = found.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("dist", F.lit(level))
        levels.append(persisted(fresh, "level"))
        reached = reached.unionByName(levels[-1])
    reached = persisted(reached, "reached")
    discard(*levels)
    return reached


def edges_within(edges: DataFrame | Steps, reached: DataFrame, depth: int, edge_types: list[str] | None = None, respect_layers: bool = True) -> DataFrame:
    """The edges at the nodes that ``reach`` found nearer than ``depth``, by seed."""
    inner = reached.where(F.col("dist") < depth).select("seed", "id")
    return steps_of(edges).both(inner, edge_types, respect_layers).drop("id", "next").dropDuplicates(["seed", *EDGE_KEY])


def traverse(edges: DataFrame | Steps, roots: DataFrame, depth: int, edge_types: list[str] | None = None, respect_layers: bool = True) -> tuple[DataFrame, DataFrame]:
    """What ``reach`` and ``edges_within`` give."""
    reached = reach(edges, roots, depth, edge_types, respect_layers)
    return reached, edges_within(edges, reached, depth, edge_types, respect_layers)


def reverse_traverse(edges: DataFrame | Steps, root: str, depth: int, spark: SparkSession) -> DataFrame:
    """(id, dist, path, edge_types) of what refers to ``root`` within ``depth``, by the path found first.

    ``path`` starts at the root; ``edge_types`` has the edge of each step.  Breadth first, a
    node's referrers are found in the order of their edges (``edge_seq``, then id), and nodes of
    a level in the order in which their parents were.  So the order of discovery is that of the
    lists of (edge_seq, id) along the paths, and needs no running number over a level.
    """
    graph = steps_of(edges)
    frontier = spark.createDataFrame([(root, 0, [root], [], [])], "id string, dist int, path array<string>, edge_types array<string>, found array<struct<seq:bigint,id:string>>")
    reached, levels = frontier, []
    for level in range(1, depth + 1):
        by = F.struct("found", "edge_seq", "edge_type", "path", "edge_types")
        met = graph.step(frontier, "back").select("next", by.alias("by")).join(reached.select(F.col("id").alias("next")), "next", "left_anti")
        best = met.groupBy("next").agg(F.min("by").alias("by"))
        step = F.struct(F.col("by.edge_seq").alias("seq"), F.col("next").alias("id"))
        frontier = best.select(
            F.col("next").alias("id"), F.lit(level).alias("dist"), F.concat("by.path", F.array("next")).alias("path"),
            F.concat("by.edge_types", F.array("by.edge_type")).alias("edge_types"), F.concat("by.found", F.array(step)).alias("found"),
        )
        frontier = persisted(frontier, "level")
        reached = reached.unionByName(frontier)
        levels.append(frontier)
    found = persisted(reached.where("dist > 0").drop("found"), "referrers")
    discard(*levels)
    return found


def running_budget(rows: DataFrame, tokens: str, order: list, most: int, first_is_free: bool) -> DataFrame:
    """Rows in ``order`` as far as their tokens fit; the first one always, if it is free.

    For short, ranked results: callers cut them to a limit before.
    """
    window = Window.orderBy(*order)
    counted = rows.withColumn("_sum", F.sum(tokens).over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(window))
    fits = F.col("_sum") <= most
    return counted.where(fits | (F.col("_rank") == 1) if first_is_free else fits).drop("_sum", "_rank")
