"""Communities by modularity: moves of nodes, refinement to connected parts, contraction, level by level.

A level starts with each node alone.  In a round, half of the nodes (by a hash of node and
round) look at the communities of their neighbours and move to the one of greatest gain, the
smallest name of equal ones, if that is more than staying gains.  As moves are made at once, a
round may lose: it is kept only if modularity rises.  Once a few rounds in a row bring nothing,
communities are split into their connected parts, which never lowers modularity, and each part
becomes a node of the next level.  Levels end when one brings nothing.

Every step is a join or a grouping of ids and numbers; each round's table is written and the one
before it deleted.  The driver sees one number a round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions.storage import discard, persisted

#: Rounds in a row without a gain that end a level, and the least gain of a move or a round.
IDLE = 3
LEAST = 1e-9


@dataclass
class Communities:
    """``rows(id, community)``, the modularity, and its values after each kept round and level."""

    rows: DataFrame
    modularity: float
    history: list[float]


def undirected(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(u, v, w) in both directions, parallel edges added up; an edge to its own node counts twice, once a direction.

    ``weights`` by edge type, 1 for others; edges of no positive weight are none.
    """
    weight = F.coalesce(*[F.when(F.col("edge_type") == t, F.lit(float(w))) for t, w in (weights or {}).items()], F.lit(1.0))
    one = edges.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), weight.alias("w")).where("w > 0")
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def modularity_of(links: DataFrame, named: DataFrame, whole: float, resolution: float = 1.0) -> float:
    """Of ``links(u, v, w)``, both directions, whose weights add up to ``whole``, under ``named(id, community)``."""
    ends = links.join(named.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(named.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    per = ends.groupBy("cu").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    return per.agg(F.sum(F.col("inside") / whole - resolution * F.pow(F.col("all") / whole, 2))).first()[0] or 0.0


def moved(links: DataFrame, named: DataFrame, whole: float, number: int, resolution: float) -> DataFrame:
    """``named`` after one round's moves."""
    strength = links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
    own = persisted(named.join(strength, "id"), "own")
    total = persisted(own.groupBy("community").agg(F.sum("k").alias("all")), "totals")
    turn = F.pmod(F.xxhash64("id", F.lit(number // 2)), F.lit(2)) == number % 2
    ways = links.where("u <> v").join(own.where(turn).select(F.col("id").alias("u")), "u")
    near = ways.join(own.select(F.col("id").alias("v"), F.col("community").alias("c")), "v").groupBy(F.col("u").alias("id"), "c").agg(F.sum("w").alias("w"))
    looked = near.join(own, "id").join(total.select(F.col("community").alias("c"), "all"), "c")
    same = F.col("c") == F.col("community")
    gain = F.col("w") - resolution * F.col("k") * (F.col("all") - F.when(same, F.col("k")).otherwise(0.0)) / whole
    best = looked.groupBy("id").agg(F.max_by(F.struct("c", gain.alias("gain")), F.struct(F.round(gain, 9), F.xxhash64("c"), "c")).alias("best"), F.max(F.when(same, gain)).alias("stay"))
    alone = own.join(total, "community").select("id", (-resolution * F.col("k") * (F.col("all") - F.col("k")) / whole).alias("apart"))
    chosen = best.join(alone, "id").where(F.col("best.gain") > F.coalesce("stay", "apart") + LEAST).select("id", F.col("best.c").alias("to"))
    after = persisted(named.join(chosen, "id", "left").select("id", F.coalesce("to", "community").alias("community")), "communities")
    discard(own, total)
    return after


def connected_parts(links: DataFrame, named: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``named`` with each community split into its connected parts, which have their smallest node's name.

    Labels spread to neighbours and jump to their own label's label, so the rounds grow with
    the logarithm of the longest path.
    """
    community = {x: named.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "uv"}
    inside = persisted(links.select("u", "v").where("u <> v").join(community["u"], "u").join(community["v"], "v").where("cu = cv").select("u", "v"), "inside")
    parts = persisted(named.select("id", F.col("id").alias("community")), "parts")
    for _ in range(most_rounds):
        near = inside.join(parts.select(F.col("id").alias("v"), "community"), "v").select(F.col("u").alias("id"), "community")
        spread = persisted(parts.unionByName(near).groupBy("id").agg(F.min("community").alias("community")), "spread")
        jump = spread.select(F.col("id").alias("community"), F.col("community").alias("next"))
        now = persisted(spread.join(jump, "community", "left").select("id", F.least("community", F.coalesce("next", "community")).alias("community")), "parts")
        changed = now.join(parts.withColumnRenamed("community", "old"), "id").where("community <> old").limit(1).count()
        discard(spread, parts)
        parts = now
        if not changed:
            discard(inside)
            return parts
    raise RuntimeError("parts did not settle")


def communities(edges: DataFrame, weights: dict[str, float] | None = None, resolution: float = 1.0, most_levels: int = 10, most_rounds: int = 40) -> Communities:
    """Communities of the nodes of ``edges(from_node, to_node, edge_type)``, each named by its smallest node.

    Reruns agree.  Nodes without an edge are not there; without edges there is no row.
    """
    links = persisted(undirected(edges, weights), "links")
    whole = links.agg(F.sum("w")).first()[0] or 1.0
    result = links.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id"))
    result = persisted(result, "result")
    value = modularity_of(links, result, whole, resolution)
    history = [value]
    for _ in range(most_levels):
        named = persisted(links.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id")), "communities")
        start, idle = value, 0
        for number in range(most_rounds):
            after = moved(links, named, whole, number, resolution)
            reached = modularity_of(links, after, whole, resolution)
            if reached > value + LEAST:
                discard(named)
                named, value, idle = after, reached, 0
                history.append(value)
            else:
                discard(after)
                idle += 1
                if idle == IDLE:
                    break
        if value <= start + LEAST:
            discard(named)
            break
        parts = connected_parts(links, named)
        value = modularity_of(links, parts, whole, resolution)
        history.append(value)
        lifted = persisted(result.join(parts.select(F.col("id").alias("community"), F.col("community").alias("now")), "community").select("id", F.col("now").alias("community")), "result")
        ends = [parts.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "uv"]
        smaller = persisted(links.join(ends[0], "u").join(ends[1], "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "links")
        discard(named, parts, result, links)
        links, result = smaller, lifted
    discard(links)
    return Communities(result, value, history)
