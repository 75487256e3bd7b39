"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import discard, materialise


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; the component is its smallest node.

    Each round points every node's larger neighbours, then its smaller ones, at the
    smallest (large star, small star).  Paths halve, so the rounds grow with the logarithm
    of the longest one.  No group is gathered: minima are pre-aggregated and joined back.
    A round's table replaces the one before it.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        last, edges = edges, materialise(small.where("u <> v").distinct(), "links")
        discard(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    named = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().join(named.select("node"), "node", "left_anti")
    found = materialise(named.unionByName(roots.select("node", F.col("node").alias("component"))), "components")
    discard(edges)
    return found


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: components are joined up by pairs of components, each once.

    The table of the labels before is deleted.
    """
    if labels is None:
        return connected_components(links.select("a", "b"))
    names = [labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
    ends = links.select("a", "b").join(names[0], "a", "left").join(names[1], "b", "left")
    pairs = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    joined = connected_components(pairs)
    old = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    new = joined.join(labels.select("node"), "node", "left_anti")
    found = materialise(old.unionByName(new), "labels")
    discard(labels, joined)
    return found
